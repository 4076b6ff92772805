"""Semantic SQL and relational analytics on Spark DataFrames."""
