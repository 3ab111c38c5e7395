"""Structured Streaming forms of telemetry and preparation."""
