"""Operations of a training-data pipeline: deduplication, scoring, tokenising, mixing, fingerprints."""
