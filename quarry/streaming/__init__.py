"""Streaming forms of the event aggregates (beyond parity)."""
