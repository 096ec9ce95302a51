"""Operators on DataFrames of pixels, segments, points and training data."""
