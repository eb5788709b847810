"""Annual climate-exposure indices on Spark DataFrames."""
