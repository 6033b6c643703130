"""Spark-native analytics and machine-learning engine."""
