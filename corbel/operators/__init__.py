"""Schema-agnostic kernels: DataFrames in, DataFrames out."""
