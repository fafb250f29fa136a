"""Plans of the relational-vector engine."""
