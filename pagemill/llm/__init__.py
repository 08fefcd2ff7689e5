"""Training-data operators: dedup, filters, scans, extraction and mixing over document tables."""
