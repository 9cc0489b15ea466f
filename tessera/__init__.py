"""Compressed images as tables: a Spark-native engine for image bitstreams."""
