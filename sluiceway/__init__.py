"""Event-pattern analytics over Spark DataFrames."""
