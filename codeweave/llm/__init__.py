"""Training-data operators: packing, scoring, formatting, deduplication, tokenising, search and scans.

Nothing else in the library imports this subpackage; it can be deleted as a whole.
"""
