"""Continuous upserts with Structured Streaming."""
