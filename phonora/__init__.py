"""Spark-native analytics for multilingual phonetic corpora."""
