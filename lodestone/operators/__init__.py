"""Operators on point and splat DataFrames."""
