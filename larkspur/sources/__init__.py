"""Table definitions, insert checks and Parquet tables of sorted parts."""
