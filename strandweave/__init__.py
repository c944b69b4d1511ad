"""strandweave: consensus-assembly analytics on Spark DataFrames."""
