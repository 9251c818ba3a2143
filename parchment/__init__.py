"""Spark-first document analytics engine."""
