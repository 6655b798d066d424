"""Operators for large training corpora: near-duplicates, language, shards, filters, search, mixing, packing."""
