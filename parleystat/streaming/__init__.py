"""Structured Streaming forms of the per-turn logic and of the token totals."""
