"""Small-business lending analytics on Spark DataFrames."""
