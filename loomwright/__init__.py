"""Batch analytics on PySpark: text mining, customer behaviour and hourly series."""

__version__ = "0.1.0"
