"""Spark-native scanning and preparation of text corpora."""
