"""Structured Streaming ingest: files arrive, the same plans run on every micro-batch."""
