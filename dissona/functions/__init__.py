"""Spark-first relational kernels."""
