"""Granary: relational analytics on Spark's DataFrame and SQL API."""

__version__ = "0.1.0"
