"""Camera-fleet event analytics expressed as Spark DataFrames."""
