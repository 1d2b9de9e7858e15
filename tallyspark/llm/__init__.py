"""Training-data operators: packing, quality, fixity, secrets, PII, mixing, HTML text, near-duplicates, top-k.

Nothing else in the library imports this package.
"""
