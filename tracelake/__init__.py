"""Security-event analytics on Spark DataFrames."""
