"""Scans and sinks: ratings, cell files, cell/factor text lines, model tables."""
