"""Operators for training data: search, deduplication, classifiers, packing, redaction."""
