"""Training-data operators: scoring, deduplication, mixing and packing of text corpora.

Nothing outside this subpackage imports it.
"""
