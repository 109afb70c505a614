"""Retail demand planning on Spark DataFrames."""
