"""Training-data operators: dedup, filters, tokenisation, retrieval, archives, packing.

Self-contained: nothing outside this subpackage imports it.
"""
