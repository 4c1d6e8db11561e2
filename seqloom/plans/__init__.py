"""Queries over the driver tables, and plan helpers."""
