"""Spark-native retrieval analytics over observability data."""
