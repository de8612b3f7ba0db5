"""Spark-native relational data synthesis and conformance."""

__version__ = "0.1.0"
