"""Spark-native corpus curation, retrieval, contamination, gating, sampling and evaluation analytics."""
