"""Operators on DataFrames of samples, trails and rules."""
