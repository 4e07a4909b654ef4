"""Tabular exploration engine on Spark DataFrames."""
