"""Structured Streaming jobs (stateless, so they share the batch transformations)."""
