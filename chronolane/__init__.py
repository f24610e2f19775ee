"""Spark-native analytics for sampled, keyed time series."""
