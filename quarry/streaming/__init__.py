"""The incremental sync as Structured Streaming."""
