"""Training-data operators: packing, decontamination, PII, language ID, secrets, dedup, tokens, fingerprints, URL rules.

Nothing else in the library imports this subpackage; it can be deleted as a whole.
"""
