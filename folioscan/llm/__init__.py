"""Training-data operators: scoring, span finding, deduplication, mixing, packing and archives."""
