"""Operators for preparing training text: quality, privacy, duplicates, leakage, token ids, shards."""
