"""Scalar functions as Columns; Python only where Spark has no such function."""
