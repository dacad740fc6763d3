"""Operators of a training-data pipeline: deduplication, filtering, extraction, tokenisation.

Nothing else in the library imports this package.
"""
