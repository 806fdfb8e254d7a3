"""Structured Streaming forms of the stateful operators (extensions; batch is the reference)."""
