"""Market-state and routing analytics on Spark DataFrames and Structured Streaming."""
