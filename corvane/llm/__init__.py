"""Training-data operators: PII, WARC, near-duplicates, BPE, packing, secrets, LM scoring, quality, top-k search.

Nothing outside this package imports it; see ``queries.py`` for the registered queries.
"""
