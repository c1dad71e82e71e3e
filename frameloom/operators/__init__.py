"""Operators from DataFrames to DataFrames: deduplication, gaps, review, sampling, video, metrics, trajectories."""
