"""Retrieval analytics over DataFrames: vectors, keywords, hybrids, collections."""
