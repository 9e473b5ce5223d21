"""Market analytics over bars for all symbols at once, as Spark DataFrames."""
