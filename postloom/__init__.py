"""Spark-native text search, ranking and index analytics."""

__version__ = "0.1.0"
