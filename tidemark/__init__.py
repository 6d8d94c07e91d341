"""Spark-native analytics for panels of daily market data."""
