"""Column helpers that the corpus operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A-Z and a-z, for lower-casing ASCII letters only.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def fresh(df, *names: str) -> list[str]:
    """``names``, each with underscores added until ``df`` has no column of that name (in any case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


#: Keys of eight bytes that are sent to every executor at most: some 100 MB there.
MOST_KEYS = 4_000_000


def only(df: DataFrame, column: str, keys: DataFrame, most: int = MOST_KEYS) -> DataFrame:
    """The rows of ``df`` whose ``column`` is in the one column of ``keys``, a written table.

    The keys are counted; if they are few they go to the rows, so that no other row is shuffled. More
    of them are met by an exchange of both sides.
    """
    keys = keys.toDF(column)
    return df.join(F.broadcast(keys) if keys.count() <= most else keys, column, "left_semi")


def utf8(c: Column) -> Column:
    """A text's bytes for Python workers; null gives no bytes."""
    return F.coalesce(c, F.lit("")).cast("binary")


def give_back() -> None:
    """Return to the system what a Python worker has freed, since it lives on, idle or in other stages, beside the executor's heap."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim is not None:
        trim(0)


def values(spark, rows: list[tuple], schema: str):
    """A small table that Spark knows the size of, so that it decides itself whether to broadcast it."""
    names = [part.split()[0] for part in schema.split(",")]
    if not rows:
        return spark.createDataFrame([], schema)
    quoted = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    body = ", ".join("(" + ", ".join(map(quoted, r)) + ")" for r in rows)
    df = spark.sql(f"SELECT * FROM VALUES {body} AS t({', '.join(names)})")
    kinds = dict(part.split() for part in schema.split(","))
    return df.select(*(F.col(n).cast(kinds[n]).alias(n) for n in names))
