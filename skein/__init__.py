"""Frontier graph analytics on Spark DataFrames."""
