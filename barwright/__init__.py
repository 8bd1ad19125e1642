"""barwright: time-series signal research and backtesting as Spark DataFrame plans."""
