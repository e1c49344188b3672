"""Spark-native engine for verifiable change histories of object stores."""

__version__ = "0.1.0"
