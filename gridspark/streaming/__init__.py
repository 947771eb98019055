"""Structured Streaming jobs over file sources; sinks are idempotent per batch."""
