"""Spark-native analytics over property graphs of services, with text search and incremental state."""
