"""eventloom: event-log analytics on Spark DataFrames."""
