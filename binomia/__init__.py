"""Scientific-name analytics on Spark DataFrames."""
