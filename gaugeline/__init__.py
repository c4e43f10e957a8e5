"""Environmental signal risk engine on Spark DataFrames."""
