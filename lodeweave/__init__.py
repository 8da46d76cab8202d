"""Spark-native analytics over source-code history."""
