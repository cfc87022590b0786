"""Process analytics and event-log mining on Spark DataFrames."""
