"""Column functions: names, percentiles, cache metrics, hashes, telemetry attributes."""
