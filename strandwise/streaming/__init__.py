"""Structured Streaming: ingest of record files in chunks."""
