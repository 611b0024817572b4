"""Continuous ingest by file-source micro-batches."""
