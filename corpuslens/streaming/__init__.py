"""Structured Streaming operators (incremental resume, running aggregates)."""
