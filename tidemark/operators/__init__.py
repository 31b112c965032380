"""Operators of the analytics engine: DataFrames in, DataFrames out."""
