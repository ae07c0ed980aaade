"""A deductive analytics engine on Spark DataFrames."""
