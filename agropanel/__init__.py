"""Spatio-temporal crop-panel analytics on Spark DataFrames."""
