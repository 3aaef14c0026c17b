"""Whole plans: ingest and search."""
