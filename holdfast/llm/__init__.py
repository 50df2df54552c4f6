"""Operators for training-data pipelines over document, page and vector tables.

Nothing else in the library imports this package. Its registered queries are in ``queries``.
"""
