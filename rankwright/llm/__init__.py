"""Training-data operators: archives, tokenizing, scoring, filters and near-duplicates."""
