"""Queries over files that still grow, and over event time."""
