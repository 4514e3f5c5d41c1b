"""Structured Streaming versions of the click tables."""
