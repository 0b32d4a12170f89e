"""Training-data operators: sharding, deduplication, mixing, extraction, scoring and packing.

Nothing outside this subpackage imports it.
"""
