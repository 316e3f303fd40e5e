"""Operators for preparing training data: filters, deduplication, mixing, packing, archives."""
