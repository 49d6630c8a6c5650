"""Operators over large text corpora: quality, deduplication, safety, scoring.

Nothing outside this subpackage imports it.
"""
