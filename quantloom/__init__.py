"""quantloom: factor research, portfolio and backtest analytics on Spark DataFrames."""
