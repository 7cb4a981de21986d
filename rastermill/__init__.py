"""Gridded imagery and image time series on Spark DataFrames."""
