"""Spark-native hybrid search and corpus analytics."""
