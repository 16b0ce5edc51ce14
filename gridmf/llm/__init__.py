"""Operators for text corpora (deduplication, scoring, scans, tokens); nothing else imports this package."""
