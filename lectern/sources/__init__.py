"""Readers of tables and note files."""
