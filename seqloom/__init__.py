"""Analytics over sequencing data with Spark DataFrames and SQL."""
