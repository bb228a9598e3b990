"""Structured Streaming and keyed state."""
