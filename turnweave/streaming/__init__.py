"""Structured Streaming forms of the status and channel operators."""
