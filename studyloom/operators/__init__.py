"""DataFrame-to-DataFrame analytics over the history tables and over task data."""
