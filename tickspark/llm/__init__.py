"""Operators that prepare text corpora for training: filters, deduplication, packing, ids, shards."""
