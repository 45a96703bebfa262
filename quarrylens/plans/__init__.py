"""Queries over the standard tables, and the same in SQL."""
