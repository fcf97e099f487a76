"""Bulk ingest and keyed merge of Parquet files, written as Spark jobs."""
