"""Architecture-graph risk analytics on Spark DataFrames."""
