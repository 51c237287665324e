"""Tidemark: a Spark-native engine for point-in-time panel evidence."""
