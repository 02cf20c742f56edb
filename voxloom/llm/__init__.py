"""Training-data operators: packing, licence and secret scans, fingerprints, deduplication, sharding, quality, decontamination and token counts."""
