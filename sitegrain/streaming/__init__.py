"""Structured Streaming versions of the page and task jobs."""
