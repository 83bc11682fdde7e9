"""Ring analytics for payment data on Spark DataFrames."""
