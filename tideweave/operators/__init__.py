"""Operators over replicated state, all from DataFrames to DataFrames."""
