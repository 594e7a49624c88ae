"""Training-data operators: quality, deduplication, mixing, tokenisation, search and scoring."""
