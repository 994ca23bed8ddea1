"""Training-data operators: fingerprints, language-model scores, deduplication, filtering, mixing, tokenising.

Nothing outside this package imports it.
"""
