"""Pictora: a Spark-native engine for multimodal (visual + text) retrieval."""
