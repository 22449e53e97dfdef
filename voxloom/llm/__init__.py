"""Training-data operators (WARC, dedup, decontamination, mixing, token stores)."""
