"""Training-data operators: scoring, filtering, deduplication, tokenising and search over text tables."""
