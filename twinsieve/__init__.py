"""Exact content deduplication on Spark: digests, duplicate groups, link and purge plans."""
