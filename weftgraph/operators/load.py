"""What a loaded graph holds: labels, props, vectors, staleness."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, FloatType

from weftgraph.schema import CODE_KINDS, NODE_KINDS


def labels_for_kind(kind: Column, roles: Column) -> Column:
    code = kind.isin(*CODE_KINDS)
    return F.when(code, F.concat(F.array(F.lit("Sym"), kind), F.coalesce(roles, F.array().cast("array<string>")))).when(kind.isin(*NODE_KINDS), F.array(kind)).otherwise(F.raise_error(F.concat(F.lit("unknown node kind "), kind)))


def vector_gate(chunks: DataFrame, dim: int, embedder: bool) -> DataFrame:
    """Drop vectors if there was no embedder, or if their length is not ``dim``; the model goes with them, the chunk stays."""
    keep = F.lit(embedder) & F.col("embedding").isNotNull() & (F.size("embedding") == dim)
    return chunks.withColumns({"embed_model": F.when(keep, F.col("embed_model")), "embedding": F.when(keep, F.col("embedding"))})


def validated(edges: DataFrame, types: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(edges that may be written, the rest with ``reason``): the type must be known, and property names made of letters and underscores."""
    odd = F.array_sort(F.filter(F.map_keys("props"), lambda k: ~k.rlike("^[A-Za-z_]+$")))
    reason = F.when(~F.col("type").isin(*types) | F.col("type").isNull(), F.concat(F.lit("type: "), F.coalesce("type", F.lit("none")))).when(F.size(odd) > 0, F.concat(F.lit("property: "), F.get(odd, F.lit(0))))
    marked = edges.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL")


def vector_bytes(vector: Column) -> Column:
    """A vector as little-endian 32-bit floats, the form in which caches hold it."""
    return packed(vector)


def vector_of(raw: Column) -> Column:
    """The vector that ``vector_bytes`` packed; null if the length does not fit."""
    return unpacked(raw)


@F.pandas_udf(BinaryType())
def packed(vectors: pd.Series) -> pd.Series:
    return vectors.map(lambda v: None if v is None else np.asarray(v, "<f4").tobytes())


@F.pandas_udf(ArrayType(FloatType()))
def unpacked(raw: pd.Series) -> pd.Series:
    return raw.map(lambda b: None if b is None or len(b) % 4 else np.frombuffer(b, "<f4"))


def is_stale(content: Column, start: Column, end: Column, digest: Column) -> Column:
    """The stored hash of a byte slice no longer fits."""
    return F.sha2(F.substring(content, start + F.lit(1), end - start), 256) != digest
