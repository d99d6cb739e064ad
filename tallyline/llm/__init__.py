"""Training-data operators: quality, dedup, tokens, secrets, sharding, archives, language, leakage, toxicity.

Nothing else in the library imports this subpackage.
"""
