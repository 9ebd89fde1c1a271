"""Streaming variants of the aggregates and lookups."""
