"""Operators for preparing training text: deduplication, mixing, sharding, packing, extraction."""
