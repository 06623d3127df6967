"""Scoped text search and rewriting on Spark DataFrames."""

__version__ = "0.1.0"
