"""Operators of a training-data pipeline: filters, deduplication, packing, scoring and token files for text tables."""
