"""Semantic operators: each takes and gives a DataFrame."""
