"""Bar-based time-series analytics on Spark DataFrames."""
