"""Training-data operators: dedup, tokenising, filters, packing and search.

Nothing else in the library imports this subpackage.
"""
