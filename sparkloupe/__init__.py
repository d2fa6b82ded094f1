"""Spark-native analytics over source files and text corpora."""
