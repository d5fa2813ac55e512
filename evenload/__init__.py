"""Skew-aware placement of keyed work on Spark, expressed with DataFrames."""
