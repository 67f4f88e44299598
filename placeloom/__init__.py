"""Place search and place analytics on Spark DataFrames."""
