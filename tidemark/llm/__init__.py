"""Training-data operators: dedup, filters, scans and mixing for text corpora. Nothing else in the library imports this subpackage."""
