"""Raster and label analytics on Spark DataFrames."""
