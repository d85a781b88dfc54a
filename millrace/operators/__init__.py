"""Operators over data: each takes DataFrames and gives DataFrames."""
