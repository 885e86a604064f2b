"""Spark-native engine for vector-tile pyramids and large text corpora."""
