"""Operators of the relational-vector engine."""
