"""Search, similarity and key-value operators over Spark DataFrames."""

__version__ = "0.1.0"
