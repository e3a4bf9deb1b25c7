"""Web pages to clean articles and ranked feeds, as Spark DataFrames."""
