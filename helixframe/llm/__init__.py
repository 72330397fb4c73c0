"""Training-data operators: tokenization, privacy, quality, deduplication, mixing.

Nothing else in the library imports this subpackage.
"""
