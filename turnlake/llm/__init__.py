"""Operators for building training corpora: scoring, deduplication, joins, sharding and mixing."""
