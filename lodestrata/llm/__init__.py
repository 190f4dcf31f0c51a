"""Training-data operators: toxicity, URL filters, near duplicates, quality, mixing, packing, token files, audio."""
