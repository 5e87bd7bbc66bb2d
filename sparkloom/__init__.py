"""Spark-native analytics for business-intelligence semantic models."""
