"""Incremental encoding with Structured Streaming."""
