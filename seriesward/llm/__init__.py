"""Operators of a training-data pipeline: encoding, search, deduplication, filters, extraction, packing."""
