"""Typed knowledge graphs and training-data operators on Spark DataFrames."""
