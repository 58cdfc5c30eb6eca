"""Structured Streaming jobs that keep stored metrics current."""
