"""Structured Streaming jobs: bars from ticks, and scores for the newest bars."""
