"""Operators of a training-data pipeline: deduplication, filtering, scoring and packing of documents.

Nothing outside this package imports it.
"""
