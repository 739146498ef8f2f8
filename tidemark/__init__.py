"""Tidemark: time-tracking analytics as Spark DataFrames."""
