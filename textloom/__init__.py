"""Spark-native retrieval, text processing and corpus hygiene operators."""
