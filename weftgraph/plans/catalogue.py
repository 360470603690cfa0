"""Every query of the engine's own operators, by name, with the SQL that must give the same rows."""

from __future__ import annotations

from weftgraph.plans import q_graph, q_more, q_rows, q_search  # noqa: F401  each module enters its queries
from weftgraph.plans.registry import ORACLE_SQL, QUERIES  # noqa: F401


def flagship(spark, sf_dir):
    """Hybrid search: text and exact vectors, fused by rank and grouped by symbol."""
    return QUERIES["m8_search_code"](spark, sf_dir)
