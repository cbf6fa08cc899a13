"""kinweave: family-history analytics on Spark DataFrames."""
