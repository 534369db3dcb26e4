"""Operators that prepare training text: deduplication, language and quality scores, token files, packing, archives, shards.

Nothing outside this package imports it.  ``queries`` holds the registered queries and their SQL.
"""
