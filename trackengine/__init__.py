"""Binned signal tracks and intervals as Spark DataFrames."""
