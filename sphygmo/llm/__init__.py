"""Training-data operators: near-duplicates, formatting, scans, scoring, mixing, packing, sharding, media."""
