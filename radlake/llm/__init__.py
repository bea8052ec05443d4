"""Training-data operators: packing, extraction, scans, deduplication, search, scoring, mixing."""
