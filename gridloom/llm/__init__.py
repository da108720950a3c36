"""Training-data operators: toxicity, mixing, tokens, dedup, secrets, fingerprints, extraction, search."""
