"""Spark-native analytics for character recognition data, and text operators for training-data pipelines."""
