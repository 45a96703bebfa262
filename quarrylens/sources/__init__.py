"""Readers of tables, archives and program files."""
