"""Training-data operators: fingerprints, token output, near-duplicates, sharding, quality, privacy, leaks, licences, packing, secrets."""
