"""Spark-native scalable machine learning and analytics."""

__version__ = "0.1.0"
