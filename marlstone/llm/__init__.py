"""Operators for training-data corpora: cleaning, deduplication, counting, packing and sharding."""
