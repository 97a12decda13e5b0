"""Approximate functional dependencies and data profiling on Spark DataFrames."""

__version__ = "0.1.0"
