"""Quillspark: document analytics on Spark DataFrames."""
