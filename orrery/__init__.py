"""Vector search and vector analytics on Spark DataFrames."""
