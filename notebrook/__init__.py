"""Notebook-corpus analytics on Spark DataFrames."""
