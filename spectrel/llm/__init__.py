"""Operators for training-data corpora: dedup, sharding, scans, mixing, classifiers, search, tokens."""
