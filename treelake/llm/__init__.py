"""Training-data operators: deduplication, privacy, language, quality, tokens, packing, HTML, toxicity, tries, manifests."""
