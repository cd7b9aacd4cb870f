"""Training-data operators: filters, extraction, deduplication, quality, mixing and tokenisation on Spark."""
