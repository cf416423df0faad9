"""Structured Streaming over run events: windows, sessions, dedup, liveness, idempotent checkpoints."""
