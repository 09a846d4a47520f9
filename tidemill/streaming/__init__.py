"""Structured Streaming wiring; each batch goes through the same functions as a batch query."""
