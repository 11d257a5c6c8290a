"""Catalogs, readers and writers."""
