"""Incremental state and streams."""
