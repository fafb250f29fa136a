"""Sources of the relational-vector engine."""
