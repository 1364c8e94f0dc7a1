"""Training-data operators: sharding, tokens, filters, duplicates, search, mixing and language models."""
