"""Structured Streaming: keyed sequences, fault plans on streams, late data, deduplication."""
