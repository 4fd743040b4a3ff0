"""Sequence analytics on PySpark: expressions, relational operators, readers and writers for biological sequence data."""

__version__ = "0.1.0"
