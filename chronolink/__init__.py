"""Temporal-graph analytics and link ranking on Spark DataFrames."""
