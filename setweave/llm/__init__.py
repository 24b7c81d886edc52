"""Training-data operators: dedup, quality, toxicity, tokenization, search, mixing, language ID.

Nothing outside this subpackage imports it.
"""
