"""Structured Streaming maintenance of the derived tables."""
