"""Palimp: version comparison and text processing on Spark DataFrames."""
