"""Structured Streaming jobs: the same operators over unbounded tables."""
