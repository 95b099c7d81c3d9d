"""Operators of a large-scale training-data pipeline, each a Spark job over DataFrames."""
