"""Spark-first record linkage."""
