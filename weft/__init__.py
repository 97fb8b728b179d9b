"""weft: repository analytics as Spark DataFrames."""
