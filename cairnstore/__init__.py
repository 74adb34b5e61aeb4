"""Content-store analytics on Spark: entries, chunks, deduplication, transforms, archives."""
