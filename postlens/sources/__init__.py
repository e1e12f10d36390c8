"""Scans, fixture views, readers and writers."""
