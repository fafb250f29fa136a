"""Training-data operators: deduplication, filtering, packing and counting of text corpora."""
