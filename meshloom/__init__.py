"""Unstructured-mesh dataflow and training-data operators on Spark DataFrames."""
