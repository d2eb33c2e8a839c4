"""Structured Streaming forms of ingest and period means."""
