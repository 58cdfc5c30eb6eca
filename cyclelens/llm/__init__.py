"""Training-data operators: formatting, search, deduplication, classification, tokenizing, scanning, archiving, packing."""
