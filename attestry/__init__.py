"""Spark-native engine for building, querying and auditing a citable document corpus."""

__version__ = "0.1.0"
