"""Training-data operators: classification, scoring, mixing and deduplication of text corpora."""
