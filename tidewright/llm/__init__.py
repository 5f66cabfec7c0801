"""Operators for preparing text corpora: mixing, search, tokens, private data, quality, duplicates, toxicity."""
