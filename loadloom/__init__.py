"""loadloom: hourly load analytics and forecasting on Spark DataFrames."""
