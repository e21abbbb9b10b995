"""Corpora as DataFrames."""
