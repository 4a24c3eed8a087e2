"""Structured Streaming over arriving pages and progress events."""
