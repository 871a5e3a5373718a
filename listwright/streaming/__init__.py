"""Structured Streaming forms of the import jobs."""
