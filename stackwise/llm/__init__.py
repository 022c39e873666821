"""Training-data operators: deduplication, packing, search, sharding, counting, scoring, mixing and URL filters.

Nothing outside this subpackage imports it, so it can be removed without touching the rest of the library.
"""
