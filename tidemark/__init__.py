"""Spark-native analytics engine with versioned tables."""
