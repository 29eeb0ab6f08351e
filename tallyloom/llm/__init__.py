"""Training-data operators: packing, tokenising, scoring, filtering, search, sharding and deduplication.

Nothing else in the library imports this subpackage; it may be removed as a whole.
"""
