"""Training-data operators: near-duplicates, filters, scoring, packing and output files."""
