"""Named entry points: selectors and declared processes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.scalars import selector


def resolve(declared: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``declared`` (name, selector) with ``entry``: the handler of a route, or the lowest symbol of a qualified name; null if neither fits."""
    s = declared.withColumn("__s", selector(F.col("selector")))
    s = s.withColumns({"__channel": F.concat(F.lit("chan:http:"), F.col("__s.service"), F.lit(":"), F.col("__s.method"), F.lit(" "), F.col("__s.name")), "service": F.col("__s.service"), "qualified_name": F.when(F.col("__s.kind") == "qualified", F.col("__s.name"))})
    handlers = edges.where("type = 'HANDLES'").groupBy(F.col("src").alias("__channel")).agg(F.min("dst").alias("__handler"))
    symbols = nodes.where("kind IN ('Module', 'Class', 'Function')").groupBy("service", "qualified_name").agg(F.min("id").alias("__symbol"))
    out = s.join(handlers, "__channel", "left").join(symbols, ["service", "qualified_name"], "left")
    return out.select("name", "selector", F.coalesce("__handler", "__symbol").alias("entry"))
