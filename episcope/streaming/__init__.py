"""Structured Streaming versions of the main checks."""
