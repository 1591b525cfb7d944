"""Training-data operators: packing, dedup, mixing, scans, search and scoring on Spark."""
