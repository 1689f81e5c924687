"""Operators for large text corpora: quality rules, sampling tokenizer, packing, secret scans,
HTML extraction, sharding, vector search, token files, edit-aware counts, near-duplicates."""
