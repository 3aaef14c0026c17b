"""Operators for preparing training data: mixing, near-duplicates, token counts, packing, scoring and filters."""
