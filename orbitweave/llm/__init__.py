"""Operators for building training data: search, mixing, tokens, extraction, quality, licences, PII, fixity, dedup."""
