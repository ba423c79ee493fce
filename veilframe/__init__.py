"""Spark-native text privacy, span analytics and corpus integrity."""

__version__ = "0.1.0"
