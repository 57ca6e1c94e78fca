"""Operators on DataFrames of recordings, windows, features and predictions."""
