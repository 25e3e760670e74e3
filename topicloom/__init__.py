"""Spark-native text-corpus cleaning and topic analytics."""

__version__ = "0.1.0"
