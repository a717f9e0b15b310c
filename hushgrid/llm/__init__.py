"""Operators of a training-data pipeline: packing, extraction, deduplication, tokens, classifiers."""
