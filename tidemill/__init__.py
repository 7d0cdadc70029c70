"""Spark-native analytics over bar-based time series and cross-sections."""
