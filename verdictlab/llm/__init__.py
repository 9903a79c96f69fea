"""Training-data operators: quality, sharding, archives, packing, mixing, token files, near-duplicates, media, PII and toxicity.

Nothing outside this subpackage imports it.
"""
