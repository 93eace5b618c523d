"""Interval-event time series and forecast evaluation on Spark DataFrames."""

__version__ = "0.1.0"
