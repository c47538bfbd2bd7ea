"""Versioned key-value change logs as Spark DataFrames."""
