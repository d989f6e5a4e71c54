"""Corpus operators for training data: search, joins, filters, tokens, shards."""
