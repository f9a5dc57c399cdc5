"""Spark-native analytics for construction take-off data."""
