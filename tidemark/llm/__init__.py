"""Training-data operators: classifiers, deduplication, tokenisation and mixing."""
