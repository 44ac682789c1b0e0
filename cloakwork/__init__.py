"""Spark-native engine for document de-identification, evaluation and review."""

__version__ = "0.1.0"
