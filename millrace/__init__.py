"""Spark-first analytics over clustered, semi-structured corpora."""

__version__ = "0.1.0"
