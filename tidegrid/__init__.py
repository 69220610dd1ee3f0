"""Features, point-in-time training sets and backtests for irregular time series, as Spark plans."""
