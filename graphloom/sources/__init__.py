"""Readers of source trees, ignore rules and project settings."""
