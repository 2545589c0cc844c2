"""Continuous import on Structured Streaming."""
