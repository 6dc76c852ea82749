"""Keyspace-shaped analytics on Spark DataFrames."""
