"""Spark-native retrieval and evaluation analytics."""
