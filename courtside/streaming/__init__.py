"""Incremental state over streams of matches."""
