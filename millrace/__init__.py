"""Millrace: trusted analytics from raw tables, as lazy Spark DataFrames."""
