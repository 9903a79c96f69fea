"""Spark-native analytics over pairwise document rankings and training corpora."""

__version__ = "0.1.0"
