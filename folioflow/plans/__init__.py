"""Queries by name."""
