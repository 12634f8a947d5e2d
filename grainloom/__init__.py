"""Grainloom: catalogue linking, feature assembly and graph analytics on Spark DataFrames."""
