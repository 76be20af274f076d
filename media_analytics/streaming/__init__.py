"""Structured Streaming ingest of landed API pages."""
