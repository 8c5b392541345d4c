"""Spark-first data mining operators."""
