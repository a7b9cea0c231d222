"""Training-data operators: extraction, scoring, search, deduplication, packing."""
