"""Training-data operators: tokenising, extraction, dedup, filtering, search and packing."""
