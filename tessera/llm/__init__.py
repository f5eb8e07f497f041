"""Training-data operators: dedup, extraction, tokenisation, filtering, placement, formatting."""
