"""Log analytics on Spark: strict ingest, a Parquet log table, look-ups, upkeep."""
