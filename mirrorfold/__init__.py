"""Duplicate content and folder similarity on Spark DataFrames."""

__version__ = "0.1.0"
