"""Operators: plain functions from DataFrames to DataFrames, for use with ``.transform``."""
