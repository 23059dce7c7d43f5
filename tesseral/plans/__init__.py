"""Region expressions and commands as DataFrames."""
