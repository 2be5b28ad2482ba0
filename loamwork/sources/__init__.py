"""Readers and writers: delimited text, JSON, XML, Parquet, tables."""
