"""Spark-native catalogue, label-processing and training-data engine."""
