"""The incremental engines as Structured Streaming queries."""
