"""Helpers that build Columns."""
