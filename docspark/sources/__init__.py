"""Readers, sinks and engine adapters."""
