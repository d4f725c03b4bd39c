"""Sources S1-S6 (line-numbered text, parallel pairs, datasets, run segments, generation logs,
vocabularies), sinks K1-K3, and Parquet input with enough scan parallelism."""
