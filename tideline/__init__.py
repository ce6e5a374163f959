"""Market analytics on Spark: bars, trend, cross-sections, scans, backtests."""
