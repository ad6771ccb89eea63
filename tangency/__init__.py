"""Certified motion analytics on Spark DataFrames."""
