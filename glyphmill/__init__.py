"""Spark-native analytics over the output of text, handwriting and formula recognizers."""
