"""Event-time windows, in batch and as Structured Streaming."""
