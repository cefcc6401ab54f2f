"""Versioned key-value and time-series analytics on PySpark DataFrames."""
