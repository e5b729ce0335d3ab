"""Structured Streaming forms of the monitors and of late, repeated records."""
