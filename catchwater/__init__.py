"""Terrain and hydrology analytics on Spark DataFrames."""
