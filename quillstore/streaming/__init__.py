"""Structured Streaming forms of the store's logs."""
