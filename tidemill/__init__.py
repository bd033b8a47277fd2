"""tidemill: a time series engine on Spark DataFrames, SQL and Structured Streaming."""
