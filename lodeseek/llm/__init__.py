"""Training-data operators: deduplication, filtering, labelling, mixing and formatting of large corpora."""
