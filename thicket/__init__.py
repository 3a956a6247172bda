"""thicket: queries over forests of named, nested intervals, on Spark DataFrames."""
