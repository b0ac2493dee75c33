"""Operators for training-data pipelines: token counts, mixing, dedup, quality, extraction, archives, search.

Nothing else in the library imports this subpackage. ``queries`` holds the registered queries and their SQL.
"""
