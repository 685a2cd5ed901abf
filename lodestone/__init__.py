"""Document ranking, log scanning, trade analytics and corpus preparation on Spark DataFrames."""
