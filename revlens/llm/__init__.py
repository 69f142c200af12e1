"""Training-data operators: language ID, quality, near-dedup, repeats, packing, BPE, search, HTML.

Nothing outside this folder imports it; ``queries.py`` holds the registered queries.
"""
