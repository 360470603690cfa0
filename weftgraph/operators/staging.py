"""The staging layer: upserts by key, endpoint checks, garbage collection and incremental deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.ids import service_of
from weftgraph.operators.dedup import first_rows


def upsert(old: DataFrame, new: DataFrame, keys: list[str], sequence: str | None = None) -> DataFrame:
    """Insert or replace by key; within a batch the row with the highest ``sequence`` wins."""
    if sequence is not None:
        new = first_rows(new, keys, [-F.col(sequence)]).drop(sequence)
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def upsert_chunks(old: DataFrame, new: DataFrame, key: str, kept: list[str]) -> DataFrame:
    """New rows replace old ones but for the ``kept`` columns (header, vector), which stay as they were; a file's new set is whole, so keys that are gone go."""
    before = old.select(key, *(F.col(c).alias(f"__{c}") for c in kept))
    return new.join(before, key, "left").select(*(F.coalesce(f"__{c}", c).alias(c) if c in kept else F.col(c) for c in new.columns))


def known_endpoints(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges both of whose ends are known nodes."""
    known = ids.select("id")
    return edges.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")


def written_and_dropped(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """By type: edges written, and dropped for an unknown end."""
    known = ids.select("id").distinct()
    s = known.select(F.col("id").alias("src"), F.lit(True).alias("has_src"))
    d = known.select(F.col("id").alias("dst"), F.lit(True).alias("has_dst"))
    both = F.col("has_src").isNotNull() & F.col("has_dst").isNotNull()
    return (
        edges.select("src", "dst", "type")
        .join(s, "src", "left")
        .join(d, "dst", "left")
        .groupBy("type")
        .agg(F.count_if(both).alias("written"), F.count_if(~both).alias("dropped"))
    )


def crosses_services(edges: DataFrame) -> DataFrame:
    """Edges that break the rule on services: only channels, processes and hand-offs may join two."""
    s, d = service_of(F.col("src")), service_of(F.col("dst"))
    shared = F.col("src").rlike("^(chan|proc):") | F.col("dst").rlike("^(chan|proc):")
    hand_off = (F.col("type") == "NEXT_SEGMENT") & F.startswith("src", F.lit("sym:")) & F.startswith("dst", F.lit("sym:")) & (F.coalesce("via_channel", F.lit("")) != "")
    return edges.where(s.isNotNull() & d.isNotNull() & (s != d) & ~shared & ~hand_off)


def orphan_channels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id")))
    return nodes.where("kind = 'Channel'").join(ends, "id", "left_anti")


def patch_nodes(nodes: DataFrame, patches: DataFrame) -> DataFrame:
    """Roles are united and sorted, props overlaid, by node id. ``patches`` has one row per id: id, add_roles, add_props."""
    joined = nodes.join(patches, "id", "left")
    roles = F.when(F.col("add_roles").isNull(), F.col("roles")).otherwise(F.array_sort(F.array_union(F.coalesce("roles", F.array().cast("array<string>")), "add_roles")))
    overlaid = overlay(F.col("props"), F.col("add_props"))
    return joined.withColumns({"roles": roles, "props": overlaid}).select(*nodes.columns)


def overlay(under: Column, over: Column) -> Column:
    """Union of two maps; ``over`` wins, whatever the session's policy on repeated keys."""
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    under, over = F.coalesce(under, none), F.coalesce(over, none)
    return F.map_concat(F.map_filter(under, lambda k, _: ~F.array_contains(F.map_keys(over), k)), over)


def without_nulls(props: Column) -> Column:
    return F.map_filter(props, lambda _, v: v.isNotNull())


def delta(old: DataFrame, new: DataFrame, keys: list[str], digest: str) -> DataFrame:
    """Each key with ``status`` added, changed, deleted or unchanged."""
    a = old.select(*keys, F.col(digest).alias("__old"), F.lit(True).alias("__in_old"))
    b = new.select(*keys, F.col(digest).alias("__new"), F.lit(True).alias("__in_new"))
    status = (
        F.when(F.col("__in_old").isNull(), "added")
        .when(F.col("__in_new").isNull(), "deleted")
        .when(F.col("__old").eqNullSafe(F.col("__new")), "unchanged")
        .otherwise("changed")
    )
    return a.join(b, keys, "full").select(*keys, status.alias("status"))


def stale_files(changes: DataFrame, refs_moved: DataFrame, keys: list[str], everything: Column | bool = False) -> DataFrame:
    """Added or changed files, and unchanged ones whose references have moved; all of them if a digest of the service moved."""
    moved = refs_moved.select(*keys, F.lit(True).alias("__moved")).distinct()
    stale = F.col("status").isin("added", "changed") | ((F.col("status") == "unchanged") & (F.col("__moved").isNotNull() | F.lit(everything)))
    return changes.join(moved, keys, "left").where(stale).select(*keys)


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """service, moved, known: whether a service's digest (service, digest) differs; one that had none before, or has none now, moved and was not ``known``."""
    a, b = before.select("service", F.col("digest").alias("__a")), after.select("service", F.col("digest").alias("__b"))
    known = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    return a.join(b, "service", "full").select("service", (~F.col("__a").eqNullSafe(F.col("__b"))).alias("moved"), known.alias("known"))


def delete_file_layer(df: DataFrame, gone: DataFrame, pairs: dict[str, str]) -> DataFrame:
    """Rows that do not come from one of the files in ``gone``; ``pairs`` maps columns of ``df`` to columns of ``gone``."""
    keys = gone.select(*(F.col(theirs).alias(mine) for mine, theirs in pairs.items())).distinct()
    return df.join(keys, list(pairs), "left_anti")


def ordered_digest(df: DataFrame, keys: list[str], parts: list[Column]) -> DataFrame:
    """SHA-256 by key over the sorted lines of a group, where a line is its parts joined by the unit separator."""
    line = F.concat_ws("\x1f", *parts)
    return df.groupBy(*keys).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n"), 256).alias("digest"))
