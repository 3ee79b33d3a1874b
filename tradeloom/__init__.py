"""Retail-sales warehouse and analytics marts expressed as Spark DataFrames."""
