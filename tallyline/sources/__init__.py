"""Batch and file sources, and sinks."""
