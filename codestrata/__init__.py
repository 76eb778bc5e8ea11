"""Codestrata: a PySpark-native analytics engine for source-code quality data."""

__version__ = "0.1.0"
