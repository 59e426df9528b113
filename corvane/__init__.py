"""Spark-native retrieval-augmented question answering over dated documents."""
