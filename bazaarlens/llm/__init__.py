"""Training-data operators: deduplication, classification, mixing, packing, scoring and search over documents.

Nothing outside this subpackage imports it.
"""
