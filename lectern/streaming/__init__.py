"""Incremental ingest and streamed answers."""
