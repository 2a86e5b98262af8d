"""Operators of a training-data pipeline: deduplication, filtering, tokenization, packing and sharding."""
