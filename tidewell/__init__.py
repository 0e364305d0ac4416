"""Tidewell: content-and-learning analytics on PySpark DataFrames."""
