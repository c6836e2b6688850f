"""barline: forecasting analytics over panels of daily price bars, on Spark DataFrames."""

__version__ = "0.1.0"
