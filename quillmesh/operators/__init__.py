"""Operators on DataFrames, by theme."""
