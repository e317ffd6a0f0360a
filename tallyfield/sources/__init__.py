"""Readers and writers: transaction ingest, sampling, Parquet/CSV tables."""
