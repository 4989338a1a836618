"""Retail catalogue analytics on PySpark: ingest, reports, insight packs, streams."""
