"""Continuous operation on Structured Streaming."""
