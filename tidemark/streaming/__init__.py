"""Incremental ingest of price bars with Structured Streaming."""
