"""Functions of the relational-vector engine."""
