"""Spark-native harvesting and analytics of news link feeds."""

__version__ = "0.1.0"
