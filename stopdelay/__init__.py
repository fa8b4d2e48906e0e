"""Spark-native analytics for scheduled-stop delays."""
