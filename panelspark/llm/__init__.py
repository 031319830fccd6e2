"""Training-data operators: each module holds one operator for large text corpora."""
