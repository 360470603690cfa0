"""Totals and rates of a run."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """100 part / whole; 0 if there is no whole."""
    return F.coalesce(F.try_divide(F.lit(100.0) * part, whole), F.lit(0.0))


def trace_confidence(walked):
    """start, confidence, external_exit_count: the least confidence of the edges walked, external exits left aside; 1 if none."""
    return walked.groupBy("start").agg(
        F.coalesce(F.min(F.when(~F.col("external"), F.col("confidence"))), F.lit(1.0)).alias("confidence"), F.count_if(F.col("external")).alias("external_exit_count")
    )


def summary(nodes, edges) -> dict:
    """Totals of a graph: nodes by kind, edges by type, CALLS whose ends are known."""
    from weftgraph.operators.staging import written_and_dropped

    ends = {r.type: (r.written, r.dropped) for r in written_and_dropped(edges, nodes).collect()}  # a row for each type
    kinds = {r["kind"]: r["count"] for r in nodes.groupBy("kind").count().collect()}
    written, dropped = ends.get("CALLS", (0, 0))
    return {"nodes": kinds, "edges": {t: w + d for t, (w, d) in sorted(ends.items())}, "dropped": sum(d for _, d in ends.values()), "calls_valid_pct": round(100.0 * written / (written + dropped), 2) if written + dropped else 0.0}
