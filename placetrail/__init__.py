"""Placement-benchmark analytics and training-data operators on Spark DataFrames."""
