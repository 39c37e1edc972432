"""Log search and analytics as Spark DataFrames."""
