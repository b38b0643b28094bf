"""Structured Streaming form of the incremental fact load."""
