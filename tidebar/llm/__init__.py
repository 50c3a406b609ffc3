"""Training-data operators: deduplication, formatting, filtering, mixing and sharding of text."""
