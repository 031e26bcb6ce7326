"""Spark-native engine for large image time series and their low-rank factors."""

__version__ = "0.1.0"
