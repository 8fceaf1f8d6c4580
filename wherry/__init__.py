"""Wherry: a Spark-native web-corpus search, retrieval and corpus-cleaning engine."""
