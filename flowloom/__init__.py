"""Passive-traffic analytics expressed as Spark DataFrames."""
