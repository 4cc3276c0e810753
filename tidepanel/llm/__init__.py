"""Training-data operators: dedup, mixing, packing, extraction, language and token tables."""
