"""Ordered-frame analytics on Spark DataFrames."""
