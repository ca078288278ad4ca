"""Structured Streaming: counts by window, dedup under a watermark, sessions."""
