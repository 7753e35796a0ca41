"""Searches over models of task data."""
