"""Operators for training-data pipelines: dedup, filters, mixing, token output."""
