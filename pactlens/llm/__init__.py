"""Training-data operators: licences, mixing, token counts, toxicity, near and exact duplicates, BPE, quality."""
