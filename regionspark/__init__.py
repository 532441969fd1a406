"""Text-region and batch-operations analytics on Spark DataFrames."""
