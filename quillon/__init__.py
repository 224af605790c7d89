"""Quillon: comparison queries over measured results, expressed as Spark DataFrames."""
