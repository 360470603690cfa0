"""Results against golden rows."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.session import spread


def precision_recall(found: DataFrame, golden: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Precision (1 if nothing was found) and recall (1 if nothing was wanted) of two sets, by group."""
    by = by or []
    side = lambda df, f, g: df.select(*by, *keys, F.lit(f).alias("__f"), F.lit(g).alias("__g"))
    either = spread(side(found, True, False).unionByName(side(golden, False, True)), [*by, *keys])
    met = either.groupBy(*by, *keys).agg(F.bool_or("__f").alias("__f"), F.bool_or("__g").alias("__g"))
    known = reduce(and_, (F.col(c).isNotNull() for c in [*by, *keys]))  # a null equals nothing
    rows = met.groupBy(*by).agg(F.count_if("__f").alias("n_found"), F.count_if("__g").alias("n_golden"), F.count_if(F.col("__f") & F.col("__g") & known).alias("hits"))
    share = lambda whole: F.round(F.coalesce(F.try_divide(F.col("hits"), F.col(whole)), F.lit(1.0)), 6)
    return rows.select(*by, "n_found", "n_golden", "hits", share("n_found").alias("precision"), share("n_golden").alias("recall"))


def found_edges(edges: DataFrame, nodes: DataFrame, types: list[str]) -> tuple[DataFrame, DataFrame]:
    """(src_service, src, dst_service, dst, type as a set by qualified names; one row with the number of ``dangling`` edges).

    HANDLES runs from the channel to its handler and is turned to be read like the others. Calls
    with a mechanism stand for hand-offs and are not calls of the source. A channel is its id, has no
    service and need not be a node; an edge dangles if another end is no node with a name.
    """
    wanted = edges.where(F.col("type").isin(*types))
    if "mechanism" in edges.columns:
        wanted = wanted.where("type != 'CALLS' OR mechanism IS NULL")
    turned = F.col("type") == "HANDLES"
    ends = wanted.select(F.when(turned, F.col("dst")).otherwise(F.col("src")).alias("src_id"), F.when(turned, F.col("src")).otherwise(F.col("dst")).alias("dst_id"), "type")
    ends = spread(ends, ends.columns).distinct()
    named = nodes.where("qualified_name != '' AND id NOT LIKE 'chan:%'")
    side = lambda name: named.select(F.col("id").alias(f"{name}_id"), F.col("service").alias(f"{name}_service"), F.col("qualified_name").alias(name), F.lit(True).alias(f"{name}_known"))
    met = ends.join(side("src"), "src_id", "left").join(side("dst"), "dst_id", "left")
    channel = F.startswith("dst_id", F.lit("chan:"))
    met = met.withColumn("dst", F.when(channel, F.col("dst_id")).otherwise(F.col("dst")))
    both = F.col("src_known").isNotNull() & (channel | F.col("dst_known").isNotNull())
    found = met.where(both).select("src_service", "src", "dst_service", "dst", "type")
    return spread(found, found.columns).distinct(), met.agg(F.count_if(~both).alias("dangling"))


def hit_rank(results: DataFrame, accepted: DataFrame) -> DataFrame:
    """question, rank (as in ``results``, null if none): the first accepted item of each question.

    ``results``: question, rank, kind, symbol; ``accepted``: question, accept; with a service in both,
    it must be the same. A class chunk accepts a symbol within it, a function chunk accepts a symbol
    that it lies in.
    """
    keys = ["question", *({"service"} & set(results.columns) & set(accepted.columns))]
    s, a = F.col("symbol"), F.col("accept")
    ok = (s == a) | ((F.col("kind") == "Class") & F.startswith(a, F.concat(s, F.lit(".")))) | ((F.col("kind") == "Function") & F.startswith(s, F.concat(a, F.lit("."))))
    hits = results.join(accepted, keys).where(ok).groupBy("question").agg(F.min("rank").alias("rank"))
    return accepted.select("question").distinct().join(hits, "question", "left")
