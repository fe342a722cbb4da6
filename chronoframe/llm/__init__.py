"""Operators that prepare training text: fingerprints, mixing, packing, filters, near-duplicate search.

Nothing outside this subpackage imports it.
"""
