"""Readers and writers: the event tables, SQLite files, Parquet and CSV."""
