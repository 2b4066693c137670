"""Structured-log analytics on Spark DataFrames."""
