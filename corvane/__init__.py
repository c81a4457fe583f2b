"""Corvane: curation and evaluation of tool-use training data, and corpus operators, on Spark DataFrames."""
