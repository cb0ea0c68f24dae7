"""Schemas, readers, log-text parsing and sinks."""
