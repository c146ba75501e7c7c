"""Analytics of irregular, multi-band time series on Spark DataFrames."""
