"""Training-data operators: tokenising, formatting, filtering, deduplicating and sharding."""
