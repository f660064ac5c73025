"""Structured Streaming jobs over link and event tables."""
