"""Training-data operators: secret scans, quality rules, toxicity, media columns,
n-gram joins, language ID, PII surrogates, substring removal, BPE and packing.

Nothing outside this subpackage imports it.
"""
