"""Spark-native analytics over source files, documents and their embeddings."""

__version__ = "0.1.0"
