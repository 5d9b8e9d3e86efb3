"""Operators of a training-data pipeline: scoring, deduplication, formatting, mixing and packing of documents.

Nothing outside this package imports it.
"""
