"""Customer-feedback analytics and corpus preparation on Spark DataFrames."""
