"""Training-data operators: classifiers, near duplicates, suffix deduplication, packing, tokens and scoring."""
