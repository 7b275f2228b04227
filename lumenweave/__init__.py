"""Spark-native analytics for image-and-text corpora."""
