"""Document-layout analytics and corpus preparation on Spark DataFrames."""
