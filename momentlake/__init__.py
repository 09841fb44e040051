"""Moments on Spark: time grids, transcripts, answers, vectors and live observations as DataFrames."""
