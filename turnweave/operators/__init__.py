"""Operators over transcript tables: DataFrames in, DataFrames out."""
