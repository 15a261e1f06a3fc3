"""Spark-native analytics for large sets of paginated documents."""

__version__ = "0.1.0"
