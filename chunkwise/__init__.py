"""Chunked, self-describing compressed binary columns as Spark DataFrames."""
