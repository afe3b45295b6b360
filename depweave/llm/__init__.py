"""Operators for large text corpora: search, filters, fingerprints, language models, mixing, tokens."""
