"""Training-data operators: token counts, search, toxicity, sharding, chat windows, quality, duplicates, mixing, BPE."""
