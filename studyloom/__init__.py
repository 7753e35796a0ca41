"""Experiment analytics on Spark: histories of studies, trials and reports as DataFrames."""
