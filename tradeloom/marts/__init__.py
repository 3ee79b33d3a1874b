"""Aggregates behind each dashboard tab; every function takes and returns DataFrames."""
