"""Operators over frames: scan, filter, projection, join, sort, records, index, text sink."""
