"""Operators for preparing training text: extraction, scoring, filtering, scanning, encoding, deduplication."""
