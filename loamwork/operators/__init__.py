"""Profiling, type inference, flattening, routing and quality operators over DataFrames."""
