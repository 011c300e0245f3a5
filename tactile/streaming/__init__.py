"""Structured Streaming forms of the capture operators."""
