"""msgflow: message and document stream analytics on Spark DataFrames."""
