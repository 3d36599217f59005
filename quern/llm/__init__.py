"""Corpus preparation operators: dedup, language ID, scans, packing, sharding.

Nothing outside this subpackage imports it; it may be deleted as a whole.
"""
