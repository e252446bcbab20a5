"""Structured Streaming: keyed windows, idempotent sinks, replay analysis."""
