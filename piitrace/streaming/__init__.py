"""Structured Streaming versions of extraction and scoring."""
