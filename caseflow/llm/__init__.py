"""Training-data operators over ``documents``: deduplication, filtering, counting, mixing, packing, sharding."""
