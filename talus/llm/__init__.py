"""Operators of a large training-data pipeline. queries() and oracle_sql() are in registry.py."""
