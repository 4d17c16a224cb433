"""Operators for preparing training data: deduplication, filtering, media, tokens, packing.

Nothing else in the library imports this subpackage.
"""
