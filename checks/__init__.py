"""Binding of the driver's tables to the retention model, query registry and SQL oracles."""
