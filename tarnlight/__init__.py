"""Analytics over panels of irregular daily time series, as lazy Spark DataFrames."""
