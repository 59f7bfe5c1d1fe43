"""Orrery: a layered batch-analytics engine on Spark DataFrames."""
