"""Joining call sites to what they call, and imports to modules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.operators.dedup import first_rows

FILE = ["service", "relpath"]


def is_callable(symbol: Column) -> Column:
    return F.endswith(symbol, F.lit("()."))


def one_per_start(occurrences: DataFrame) -> DataFrame:
    """At one start byte the lowest symbol stands."""
    return first_rows(occurrences, [*FILE, "start_byte"], [F.col("symbol"), F.col("end_byte")], ["symbol", "end_byte"])


def span_join(calls: DataFrame, refs: DataFrame) -> DataFrame:
    """``calls`` (service, relpath, pos, ...) with the ``symbol`` of the ref at ``pos``, else of the last ref before it if that reaches beyond ``pos``.

    A predecessor lookup in one pass: both sides are put in order within a file and each call reads
    the last ref; no pair of a call and a ref that is not its predecessor is ever made.
    """
    rest = [c for c in calls.columns if c not in (*FILE, "pos")]
    r = one_per_start(refs).select(*FILE, F.col("start_byte").alias("pos"), F.struct("symbol", "start_byte", "end_byte").alias("__ref"), F.lit(None).cast(calls.select(F.struct(*rest) if rest else F.struct(F.lit(0).alias("x"))).schema[0].dataType).alias("__rest"), F.lit(0).alias("__side"))
    c = calls.select(*FILE, "pos", F.lit(None).cast(r.schema["__ref"].dataType).alias("__ref"), (F.struct(*rest) if rest else F.struct(F.lit(0).alias("x"))).alias("__rest"), F.lit(1).alias("__side"))
    w = Window.partitionBy(*FILE).orderBy("pos", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = r.unionByName(c).withColumn("__last", F.last("__ref", ignorenulls=True).over(w)).where("__side = 1")
    hit = (F.col("__last.start_byte") == F.col("pos")) | (F.col("pos") < F.col("__last.end_byte"))
    return seen.select(*FILE, "pos", *(F.col(f"__rest.{x}").alias(x) for x in rest), F.when(hit, F.col("__last.symbol")).alias("symbol"))


def symbol_at(points: DataFrame, occurrences: DataFrame) -> DataFrame:
    """``points`` (service, relpath, pos) with the lowest symbol that starts there, or null."""
    at = occurrences.groupBy(*FILE, F.col("start_byte").alias("pos")).agg(F.min("symbol").alias("symbol"))
    return points.join(at, [*FILE, "pos"], "left")


def outcomes(calls: DataFrame, defs: DataFrame, local_defs: DataFrame, singletons: DataFrame, confidence: float, resolution: str) -> DataFrame:
    """Adds outcome, dst, confidence and resolution to calls that carry the ``symbol`` of their ref (or null).

    unresolved: no ref, or a local one that its file does not define; external: a symbol that the
    service does not define; else joined. Where the first three fail or the target is no callable,
    a singleton candidate (call_id, target, tier) may redirect; it never gets more than the run's tier.
    """
    d = defs.select("service", "symbol").distinct().withColumn("__def", F.lit(True))
    loc = local_defs.select(*FILE, "symbol").distinct().withColumn("__loc", F.lit(True))
    s = singletons.select("call_id", F.col("target").alias("__target"), F.col("tier").alias("__tier"))
    rows = calls.join(d, ["service", "symbol"], "left").join(loc, [*FILE, "symbol"], "left").join(s, "call_id", "left")
    local = F.startswith("symbol", F.lit("local "))
    plain = (
        F.when(F.col("symbol").isNull(), "unresolved")
        .when(local, F.when(F.col("__loc").isNotNull(), "joined").otherwise("unresolved"))
        .when(F.col("__def").isNull(), "external")
        .otherwise("joined")
    )
    redirect = F.col("__target").isNotNull() & ((plain != "joined") | ~is_callable(F.col("symbol")))
    return rows.select(
        *calls.columns,
        F.when(redirect, "joined").otherwise(plain).alias("outcome"),
        F.when(redirect, F.col("__target")).when(plain == "joined", F.col("symbol")).alias("dst"),
        F.when(redirect, F.least(F.col("__tier"), F.lit(confidence))).otherwise(F.lit(confidence)).alias("confidence"),
        F.lit(resolution).alias("resolution"),
    )


def call_edges(joined: DataFrame) -> DataFrame:
    """src, dst, callsite_count and the first call site's evidence, by (relpath, pos)."""
    first = F.min(F.struct("relpath", "pos", "resolution", "confidence"))
    return (
        joined.where("outcome = 'joined'")
        .groupBy("src", "dst")
        .agg(F.count(F.lit(1)).alias("callsite_count"), first.alias("f"))
        .select("src", "dst", "callsite_count", F.col("f.relpath").alias("evidence_file"), F.col("f.pos").alias("evidence_pos"), F.col("f.resolution").alias("resolution"), F.col("f.confidence").alias("confidence"))
    )


def caller_ids(calls: DataFrame, def_symbols: DataFrame, nodes: DataFrame) -> DataFrame:
    """Adds ``src``: the enclosing def's symbol if it is a node, else its structural id, else the module."""
    by_symbol = def_symbols.select(*FILE, F.col("start_byte").alias("def_pos"), F.col("symbol").alias("__sym"))
    known = nodes.select(F.col("id").alias("__sym"), F.lit(True).alias("__known"))
    rows = calls.join(by_symbol, [*FILE, "def_pos"], "left").join(known, "__sym", "left")
    return rows.select(*calls.columns, F.coalesce(F.when(F.col("__known"), F.col("__sym")), "structural_id", "module_id").alias("src"))


def fallback_resolve(calls: DataFrame, top_defs: DataFrame, imports: DataFrame, modules: DataFrame) -> DataFrame:
    """``calls`` (service, relpath, pos, name) with the symbol of a top-level def of that name in the file, else of the last import of it."""
    own = top_defs.select(*FILE, "name", F.col("symbol").alias("__own"))
    last = imports.groupBy(*FILE, "name").agg(F.max_by("module", "pos").alias("__module"), F.max_by("target", "pos").alias("__target"))
    there = top_defs.join(modules, FILE).select("service", F.col("module").alias("__module"), F.col("name").alias("__target"), F.col("symbol").alias("__imported"))
    rows = calls.join(own, [*FILE, "name"], "left").join(last, [*FILE, "name"], "left").join(there, ["service", "__module", "__target"], "left")
    return rows.select(*calls.columns, F.coalesce("__own", "__imported").alias("symbol"))


def resolve_imports(imports: DataFrame, modules: DataFrame) -> DataFrame:
    """``imports`` (service, relpath, target, name) with the module each means: ``target.name`` if there is one, else ``target``, else null (external)."""
    base = F.when(F.col("target") == "", F.col("name")).otherwise(F.concat_ws(".", "target", "name"))
    deep = modules.select("service", F.col("module").alias("__name"), F.col("module").alias("__deep"))
    flat = modules.select("service", F.col("module").alias("target"), F.col("module").alias("__flat"))
    rows = imports.withColumn("__name", base).join(deep, ["service", "__name"], "left").join(flat, ["service", "target"], "left")
    return rows.select(*imports.columns, F.coalesce("__deep", "__flat").alias("module"))


def cls_construction(calls: DataFrame, defs: DataFrame) -> DataFrame:
    """``cls(...)`` inside a class method means the class: ``symbol`` is the enclosing symbol and ``(cls)``; adds ``dst``, or null."""
    owner = F.regexp_extract("symbol", r"^(.*#)\w+\(\)\.\(cls\)$", 1)
    known = defs.select(F.col("symbol").alias("__cls")).distinct()
    rows = calls.withColumn("__cls", F.nullif(owner, F.lit("")))
    return rows.join(known.withColumn("__ok", F.lit(True)), "__cls", "left").select(*calls.columns, F.when(F.col("__ok"), F.col("__cls")).alias("dst"))


def singleton_targets(sites: DataFrame, singles: DataFrame, imports: DataFrame, methods: DataFrame) -> DataFrame:
    """Calls on module singletons: call_id, target, tier.

    ``sites``: call_id, service, module, receiver, callee. A receiver is a singleton if its name
    belongs to one identity only and it is defined in the file or imported from where it is. Its
    method is the rebuilt symbol if that is defined (1.0), else the only definition of that class and
    method (0.6).
    """
    unique = singles.groupBy("service", "name").agg(F.count_distinct("module", "class_name").alias("n"), F.min("module").alias("origin"), F.min("class_name").alias("class_name"), F.min("class_symbol").alias("class_symbol")).where("n = 1")
    met = sites.join(unique.select("service", F.col("name").alias("receiver"), "origin", "class_name", "class_symbol"), ["service", "receiver"])
    brought = imports.select("service", "module", F.col("name").alias("receiver"), F.col("target").alias("origin")).distinct().withColumn("__imported", F.lit(True))
    met = met.join(brought, ["service", "module", "receiver", "origin"], "left").where((F.col("module") == F.col("origin")) | F.col("__imported"))
    met = met.withColumn("symbol", F.concat("class_symbol", "callee", F.lit("().")))
    exact = methods.select("service", "symbol").distinct().withColumn("__exact", F.lit(True))
    by_name = methods.groupBy("service", "class_name", F.col("method").alias("callee")).agg(F.count(F.lit(1)).alias("__n"), F.min("symbol").alias("__only"))
    met = met.join(exact, ["service", "symbol"], "left").join(by_name, ["service", "class_name", "callee"], "left")
    target = F.when(F.col("__exact"), F.col("symbol")).when(F.col("__n") == 1, F.col("__only"))
    return met.select("call_id", target.alias("target"), F.when(F.col("__exact"), 1.0).otherwise(0.6).alias("tier")).where("target IS NOT NULL")
