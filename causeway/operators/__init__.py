"""Network operators: DataFrames in, DataFrames out."""
