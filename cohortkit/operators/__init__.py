"""Operators: each takes and returns DataFrames built from native Spark expressions."""
