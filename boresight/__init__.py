"""Spark-native analytics for ground-investigation data."""
