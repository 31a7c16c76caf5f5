"""Keyed record reconciliation on PySpark."""
