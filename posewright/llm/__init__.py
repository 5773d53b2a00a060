"""Training-data operators: quality, tokens, deduplication, licences, toxicity, language, URLs, decontamination."""
