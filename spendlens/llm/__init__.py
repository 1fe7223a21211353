"""Training-data operators: quality, toxicity, near-duplicates, mixing, tokens, archives.

Nothing else in the library imports this subpackage.
"""
