"""Spark-native engine for messy, multi-source event corpora."""
