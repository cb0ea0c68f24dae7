"""Structured Streaming versions of the record-at-a-time checks."""
