"""Structured Streaming jobs (feedback intake and incremental refresh)."""
