"""Relational operators: DataFrames in, DataFrame out, nothing runs until an action."""
