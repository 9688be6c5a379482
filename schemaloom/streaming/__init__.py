"""Structured Streaming forms of the registration jobs."""
