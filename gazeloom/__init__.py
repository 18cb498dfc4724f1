"""Gaze and visual-search analytics on Spark DataFrames."""
