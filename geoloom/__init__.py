"""Geoloom: multi-temporal raster and vector patches as Spark DataFrames."""
