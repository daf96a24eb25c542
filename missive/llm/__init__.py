"""Training-data operators: cleaning, deduplication, mixing, tokens and packing.

Nothing outside this folder imports it.
"""
