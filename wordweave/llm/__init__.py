"""Operators for preparing training text: filters, duplicates, tokens."""
