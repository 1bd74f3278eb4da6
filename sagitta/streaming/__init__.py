"""Structured Streaming (an addition: the batch operators don't need it)."""
