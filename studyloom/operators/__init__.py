"""Operators from a DataFrame to a DataFrame."""
