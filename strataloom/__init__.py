"""Spark-native analytics over repositories of source files and documents."""

__version__ = "0.1.0"
