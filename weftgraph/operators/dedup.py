"""Choosing one row of several that assert the same fact, by an explicit total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.ids import numbered
from weftgraph.session import spread


def first_rows(df: DataFrame, keys: list[str], order: list[Column], values: list[str] | None = None) -> DataFrame:
    """The first row of each key. An aggregate with partial sums over portions of bounded size, so a hot key meets in no single task."""
    values = values or [c for c in df.columns if c not in keys]
    ranked = F.min_by(F.struct(*values), F.struct(*(c.alias(f"o{k}") for k, c in enumerate(order))))
    return spread(df, keys).groupBy(*keys).agg(ranked.alias("r")).select(*keys, "r.*")


def resolution_rank(resolution: Column) -> Column:
    return F.when(resolution == "trace_validated", 3).when(resolution == "static", 2).when(resolution == "dynamic", 1).when(resolution == "heuristic", 0).otherwise(-1)


def dedup_edges(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst, type, via_channel): best resolution, then confidence, then the least origin."""
    extra = [c for c in ("evidence_file", "evidence_line") if c in edges.columns]
    order = [-resolution_rank(F.col("resolution")), -F.col("confidence"), F.col("origin_service"), *map(F.col, extra)]
    return first_rows(edges, ["src", "dst", "type", "via_channel"], order)


def disambiguate(defs: DataFrame, scope: list[str], id_col: str, order: list[str]) -> DataFrame:
    """Number repeated ids within a scope (a file): the n-th gets ``~n``."""
    from pyspark.sql import Window

    nth = F.row_number().over(Window.partitionBy(*scope, id_col).orderBy(*order))
    return defs.withColumn(id_col, numbered(F.col(id_col), nth))
