"""Metric-space analytics on DataFrames."""
