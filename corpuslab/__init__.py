"""Corpus analytics on Spark: cleaning, deduplication, splits, statistics, tokens, metrics and reasoning data as DataFrame operators."""
