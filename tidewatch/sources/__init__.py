"""Readers and the canonical event schema."""
