"""Structured Streaming forms of blocks, sessions, continuity and unwrapping."""
