"""Training-data operators: chat roles, similarity joins, toxicity, WARC, packing, vector search, repeats,
mixing, fingerprints, sharding, personal data, Merkle manifests and word runs. Nothing else in the library imports this package."""
