"""Point-in-time analytics on Spark: every public operator maps DataFrames to DataFrames."""
