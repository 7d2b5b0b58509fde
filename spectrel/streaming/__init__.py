"""Structured Streaming jobs over the batch column functions."""
