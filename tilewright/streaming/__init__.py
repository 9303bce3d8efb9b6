"""Structured Streaming forms of the batch worker and the strip accumulator."""
