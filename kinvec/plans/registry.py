"""Registered queries over the reference's operators and their DuckDB SQL."""

from __future__ import annotations

from . import contracts, geometry, nulls, retrieval, sensitivity, summaries, texts  # noqa: F401  they register their queries
from .common import ORACLE_SQL, QUERIES  # noqa: F401

FLAGSHIP = "heldout_forward_retrieval"
