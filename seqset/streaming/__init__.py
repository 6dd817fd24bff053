"""Structured Streaming jobs on request and response streams."""
