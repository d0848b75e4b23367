"""Training-data operators: dedup, filters, tokenizers, archives, formatting.

Nothing outside this subpackage imports it; it may be deleted as a whole.
"""
