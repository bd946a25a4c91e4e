"""Training-data operators: near-duplicate search, tokenisation, packing, filtering and retrieval.

Nothing outside this subpackage imports it.
"""
