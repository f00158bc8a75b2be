"""Operators for preparing training text: quality, mixing, formatting, scoring, tokenising, deduplication, search."""
