"""Operators on DataFrames of facts."""
