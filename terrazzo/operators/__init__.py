"""Operators on relations: DataFrames in, lazy DataFrames out."""
