"""Operators of the feed engine: DataFrames in, a DataFrame out."""
