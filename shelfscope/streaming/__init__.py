"""Structured Streaming forms of ingest and refresh."""
