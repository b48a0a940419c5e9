"""Training-data operators: language, toxicity, quality, duplicates, search, tokens and mixing."""
