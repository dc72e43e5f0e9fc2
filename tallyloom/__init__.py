"""tallyloom: learning analytics on Spark DataFrames, SQL and Structured Streaming."""
