"""Spark-native operators for preparing and analysing training data."""
