"""Training-data operators: search, classification, filtering, deduplication and tokenisation.

Nothing outside this subpackage imports it.
"""
