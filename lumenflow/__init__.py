"""Spark-native analytics over media-derived tables."""
