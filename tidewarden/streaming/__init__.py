"""Streams: the same decisions on messages as they arrive, and drift as keyed state."""
