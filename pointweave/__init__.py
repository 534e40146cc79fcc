"""Incremental surface reconstruction from streamed point-cloud segments, on DataFrames."""
