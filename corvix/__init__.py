"""Retrieval analytics on Spark DataFrames: vector, lexical and hybrid search, index building and evaluation."""

__version__ = "0.1.0"
