"""Glyphlake: bilevel document pages and their symbols as Spark DataFrames."""

__version__ = "0.1.0"
