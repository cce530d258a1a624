"""Operators for preparing training text, built on Spark DataFrames."""
