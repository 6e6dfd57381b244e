"""Spark-native detection-event analytics."""
