"""Boosted trees on Spark DataFrames."""
