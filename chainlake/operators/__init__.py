"""Relational and temporal operators: DataFrames in, DataFrames out."""
