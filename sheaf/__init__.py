"""Document-batch processing on Spark: operators are functions from DataFrames to DataFrames."""
