"""Operators for large training-data corpora: deduplication, screening and mixing.

Nothing else in the library imports this subpackage.
"""
