"""Operators over DataFrames: the model layer, filters, profiling, comparison and clustering."""
