"""Operators on clouds and graphs, from DataFrames to DataFrames."""
