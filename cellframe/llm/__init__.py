"""Operators for training-data pipelines: packing, deduplication, tokens, search, classifiers."""
