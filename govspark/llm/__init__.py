"""Operators for preparing training text: deduplication, filtering, scoring and packing of a documents table."""
