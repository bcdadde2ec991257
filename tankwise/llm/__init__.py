"""Training-data operators: near duplicates, models, tokenizers, sharding."""
