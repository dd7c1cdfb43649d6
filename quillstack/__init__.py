"""Spark-native retrieval, ranking, mining and evaluation engine."""
