"""Training-data operators: deduplication, filtering, tokenising, mixing and scoring of text corpora.

Nothing else in the package imports this subpackage; it can be removed as a whole.
"""
