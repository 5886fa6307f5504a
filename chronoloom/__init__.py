"""A Spark-native engine for metric time series."""
