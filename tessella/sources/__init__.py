"""Declared tables: the CREATE TABLE dialect, the catalog and versioned storage."""
