"""Annotation scoring, box geometry and staged annotation pipelines on Spark DataFrames."""
