"""Operators on DataFrames: normalising, matching, features, learning, evaluation."""
