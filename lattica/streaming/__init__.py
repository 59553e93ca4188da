"""Incremental (Structured Streaming) forms of operators."""
