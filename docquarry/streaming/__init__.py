"""Structured Streaming: intake of new files."""
