"""Streaming jobs over live telemetry."""
