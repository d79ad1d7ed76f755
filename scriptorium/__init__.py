"""Text forensics and corpus preparation on Spark DataFrames."""
