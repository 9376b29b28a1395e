"""Spark-native rating, ranking and curation engine."""
