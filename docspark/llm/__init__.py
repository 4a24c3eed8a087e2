"""Training-data operators (extraction, dedup, scans, tokenizing, mixing, filtering).

Nothing outside this subpackage imports it.
"""
