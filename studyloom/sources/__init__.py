"""Where histories are kept: in memory and as Parquet event tables."""
