"""Spark DataFrame operators for provider files, care episodes and data discovery."""

__version__ = "0.1.0"
