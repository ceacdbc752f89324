"""Group-accounting consolidation on Spark DataFrames."""
