"""Operators for preparing training text: filters, duplicates, tokens, archives and mixing."""
