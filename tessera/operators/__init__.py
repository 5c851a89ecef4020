"""Operators of the graph engine, each from DataFrames to DataFrames."""
