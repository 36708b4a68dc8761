"""Spark-native analytics for prediction-market and price time-series data."""
