"""Spark-native retrieval over linked text."""
