"""Analytics over monthly snapshots of residential sale and rent listings, on Spark DataFrames."""
