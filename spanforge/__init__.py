"""Span measurement and corpus preparation on PySpark."""
