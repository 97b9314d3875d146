"""Operators over entities and edges."""
