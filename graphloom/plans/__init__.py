"""Queries on the driver tables."""
