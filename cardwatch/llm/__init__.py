"""Training-data operators: mixing, packing, scans, scores, search and deduplication over document tables."""
