"""Training-data operators: token shards, filters, deduplication, search, packing.

Nothing outside this subpackage imports it."""
