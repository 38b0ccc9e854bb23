"""Training-data operators: tokenizers, filters, deduplication, packing, archives, search."""
