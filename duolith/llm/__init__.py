"""Training-data operators: deduplication, filtering, packing, tokenising, formatting."""
