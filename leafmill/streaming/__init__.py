"""Structured Streaming forms of the running operators."""
