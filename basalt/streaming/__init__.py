"""Keyed messages: incremental publishing and consuming with Structured Streaming."""
