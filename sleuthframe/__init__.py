"""A source-analysis engine on Spark DataFrames."""
