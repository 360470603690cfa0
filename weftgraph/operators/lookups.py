"""Point lookups of nodes, for any number of keys at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.schema import CODE_KINDS


def by_ids(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes whose ids are asked for; ids that no node has are absent."""
    return nodes.join(ids.select("id").distinct(), "id", "left_semi")


def of_kind(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.where(F.col("kind") == kind)


def by_qualified_name(nodes: DataFrame, names: DataFrame) -> DataFrame:
    """service, qualified_name, id: of code nodes only, the lowest id where several have the name."""
    code = nodes.where(F.col("kind").isin(*CODE_KINDS)).join(names.select("service", "qualified_name").distinct(), ["service", "qualified_name"], "left_semi")
    return code.groupBy("service", "qualified_name").agg(F.min("id").alias("id"))


def repeated_ids(nodes: DataFrame) -> DataFrame:
    """id, n: ids that several rows have; a graph is loaded only if there is none."""
    return nodes.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
