"""Retrieval operators: each takes and returns DataFrames."""
