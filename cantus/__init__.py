"""Timed music annotations as Spark DataFrames."""
