"""Training-data operators: sharding, tokens, extraction, deduplication, packing, classifiers and search.

Nothing outside this subpackage imports it.
"""
