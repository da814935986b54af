"""Spark-native text-quality analytics."""
