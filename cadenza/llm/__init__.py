"""Training-data operators: quality, deduplication, decontamination, packing and text extraction."""
