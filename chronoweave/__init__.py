"""Temporal event-graph analytics on Spark DataFrames."""
