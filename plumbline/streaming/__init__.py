"""Structured Streaming forms of the masking, limiting and freshness operators."""
