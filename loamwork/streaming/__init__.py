"""Structured Streaming ingest into the same routes as batch."""
