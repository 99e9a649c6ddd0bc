"""Structured Streaming: scoring new ventures as they arrive."""
