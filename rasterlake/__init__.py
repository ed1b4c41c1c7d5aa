"""Raster and point analytics on Spark DataFrames."""
