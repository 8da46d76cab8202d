"""Operators for training data: clusters, near-duplicates, credentials, syntax, provenance, splitting, neighbours, tokens, leaks, abuse."""
