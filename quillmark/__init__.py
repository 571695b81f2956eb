"""Spark-native engine for building, auditing and scoring text corpora."""
