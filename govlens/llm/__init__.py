"""Operators for building training data: dedup, filters, scoring, packing and sharding."""
