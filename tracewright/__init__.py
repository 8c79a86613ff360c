"""Impact analysis over source-code facts, expressed as Spark DataFrames."""
