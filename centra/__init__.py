"""Vector clustering on Spark DataFrames."""
