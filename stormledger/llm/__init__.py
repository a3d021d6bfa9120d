"""Operators for training-data corpora: cleaning, scoring, search, encoding, dedup, packing, sharding."""
