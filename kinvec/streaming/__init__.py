"""Streaming of the relational-vector engine."""
