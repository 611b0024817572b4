"""The graph query language: syntax and its compilation to DataFrames."""
