"""Operators for training-data pipelines: deduplication, joins, tokens, scoring, archives and packing."""
