"""A Spark-native engine for test-quality data."""
