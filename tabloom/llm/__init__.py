"""Operators for preparing training corpora: counting, scanning, filtering, deduplicating, mixing, encoding.

Nothing else in the library imports this package.
"""
