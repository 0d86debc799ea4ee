"""Streams: micro-batches over file sources."""
