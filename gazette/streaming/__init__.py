"""Structured Streaming forms of intake, dedup, counting and retention."""
