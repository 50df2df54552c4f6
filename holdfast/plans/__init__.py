"""Compositions of operators: metric queries, dashboard questions, the daily run."""
