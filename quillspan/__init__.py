"""Spark-native analytics for documents that contain glossed examples of languages."""
