"""Relational grounding and trajectory analytics on Spark DataFrames."""
