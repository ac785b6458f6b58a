"""Structured Streaming forms of the ingest, scoring and summary operators."""
