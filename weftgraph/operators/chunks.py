"""Chunks: spans, packing, headers, hashes and missing vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.session import cut


def files_with_known_spans(spans: DataFrame, nodes: DataFrame, key: list[str]) -> DataFrame:
    """service, relpath of files all of whose spans are staged nodes; one unknown span leaves out the whole file."""
    known = nodes.select(*key).distinct().withColumn("__known", F.lit(True))
    return spans.join(known, key, "left").groupBy("service", "relpath").agg(F.bool_and(F.col("__known").isNotNull()).alias("ok")).where("ok").drop("ok")


FILE = ["service", "relpath"]
MAX_BYTES, MOST_INT = 2000, 2**31 - 1
HEADER_IMPORTS, HEADER_CALLS, HEADER_DOC = 8, 5, 120


def pack_lines(text, max_bytes: int = MAX_BYTES):
    """Whole-line pieces of at most ``max_bytes`` bytes each; a longer line stands alone. Pieces join to the text."""
    lines = F.split(text, "(?<=\n)")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(acc, line):
        fits = (acc["open"] == "") | (F.octet_length(acc["open"]) + F.octet_length(line) <= max_bytes)
        return F.struct(F.when(fits, acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])).alias("done"), F.when(fits, F.concat(acc["open"], line)).otherwise(line).alias("open"))

    return F.aggregate(lines, start, step, lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(F.array_append(acc["done"], acc["open"])))


def chunk_rows(texts: DataFrame, id_col: str, text_col: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """chunk_id, symbol_id, ord, text, start_line, end_line, content_hash of each piece."""
    rows = texts.select(F.col(id_col).cast("string").alias("symbol_id"), F.posexplode(pack_lines(F.col(text_col), max_bytes)).alias("ord", "text"))
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    before = F.coalesce(F.sum(breaks).over(Window.partitionBy("symbol_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = before + breaks + F.when(F.endswith("text", F.lit("\n")), 0).otherwise(1)
    return rows.select(
        F.concat("symbol_id", F.lit("#c"), "ord").alias("chunk_id"), "symbol_id", "ord", "text", (before + 1).cast("int").alias("start_line"), last.cast("int").alias("end_line"), F.sha2("text", 256).alias("content_hash")
    )


def definition_spans(files: DataFrame, defs: DataFrame, modules: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """service, relpath, symbol_id, kind, start, end, after, until, whole: the disjoint byte spans that a file is cut into.

    What stands before the first top-level definition belongs to the module, and is never split. A
    top-level definition is a span of its own; a class over ``max_bytes`` gives one to each of its
    methods and keeps what stands before, between (``after`` a method, ``until`` the next) and behind
    them. Definitions within functions have no span of their own.
    """
    top = defs.where("parent IS NULL")
    big = top.where((F.col("kind") == "Class") & (F.col("end_byte") - F.col("start_byte") > max_bytes))
    owners = big.select(*FILE, F.col("idx").alias("parent"), F.col("id").alias("owner"), F.col("start_byte").alias("from"), F.col("end_byte").alias("upto"))
    methods = defs.join(owners, [*FILE, "parent"])
    split = methods.select(*FILE, F.col("parent").alias("idx")).distinct()
    span = lambda symbol, kind, start, end, after, until, whole: [*FILE, F.col(symbol).alias("symbol_id"), kind.alias("kind"), start.cast("bigint").alias("start"), end.cast("bigint").alias("end"), after.alias("after"), until.alias("until"), F.lit(whole).alias("whole")]
    no, yes, kind = F.lit(False), F.lit(True), F.col("kind")
    own = top.join(split, [*FILE, "idx"], "left_anti").unionByName(methods.select(*top.columns))
    out = own.select(*span("id", kind, F.col("start_byte"), F.col("end_byte"), no, no, False))
    last = F.lag("end_byte").over(Window.partitionBy(*FILE, "parent").orderBy("start_byte", "idx"))
    between = methods.withColumn("last", last)
    out = out.unionByName(between.select(*span("owner", F.lit("Class"), F.coalesce("last", "from"), F.col("start_byte"), F.col("last").isNotNull(), yes, False)))
    behind = methods.groupBy(*FILE, "owner", "upto").agg(F.max("end_byte").alias("last"))
    out = out.unionByName(behind.select(*span("owner", F.lit("Class"), F.col("last"), F.col("upto"), yes, no, False)))
    first = top.groupBy(*FILE).agg(F.min("start_byte").alias("first"))
    head = files.select(*FILE, F.octet_length("content").alias("size")).join(modules.select(*FILE, "module_id"), FILE).join(first, FILE, "left")
    return out.unionByName(head.select(*span("module_id", F.lit("Module"), F.lit(0), F.coalesce("first", "size"), no, no, True)))


def chunk_files(files: DataFrame, defs: DataFrame, modules: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """chunk_id, symbol_id, kind, service, relpath, ord, text, start_line, end_line, content_hash: spans of definitions, long ones in whole-line pieces.

    A file's spans meet its content once; ``ord`` counts a symbol's pieces in the order of the file.
    """
    spans = definition_spans(files, defs, modules, max_bytes).groupBy(*FILE).agg(F.collect_list(F.struct("symbol_id", "kind", "start", "end", "after", "until", "whole")).alias("spans"))
    part = lambda s: F.substring(F.col("content"), s["start"].cast("int") + 1, (s["end"] - s["start"]).cast("int")).cast("string")
    head = lambda s: F.substring(F.col("content"), F.lit(1), s["start"].cast("int")).cast("string")
    cut_out = F.transform("spans", lambda s: F.struct(s.alias("s"), part(s).alias("text"), F.size(F.split(head(s), "\n")).alias("line")))
    rows = files.select(*FILE, "content").join(spans, FILE).select(*FILE, F.explode(cut_out).alias("x")).select(*FILE, "x.s.*", "x.text", "x.line")
    leading = F.col("after") & F.startswith("text", F.lit("\n"))
    rows = rows.withColumns({"line": F.col("line") + leading.cast("int"), "text": F.when(leading, F.substring("text", 2, MOST_INT)).otherwise(F.col("text"))})
    rows = rows.withColumn("text", F.when(F.col("until"), F.regexp_replace("text", "[ \t]+$", "")).otherwise(F.col("text"))).where("text RLIKE '[^ \\\\t\\\\r\\\\n\\\\f]'")
    pieces = F.when(F.col("whole") | (F.octet_length("text") <= max_bytes), F.array("text")).otherwise(pack_lines(F.col("text"), max_bytes))
    rows = rows.select(*FILE, "symbol_id", "kind", "start", "line", F.posexplode(pieces).alias("nth", "text"))
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    of_span = Window.partitionBy("symbol_id", "start").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start_line", (F.col("line") + F.coalesce(F.sum(breaks).over(of_span), F.lit(0))).cast("int"))
    rows = rows.withColumn("ord", F.row_number().over(Window.partitionBy("symbol_id").orderBy("start", "nth")) - 1)
    end = F.col("start_line") + breaks - F.endswith("text", F.lit("\n")).cast("int")
    return rows.select(F.concat("symbol_id", F.lit("#c"), "ord").alias("chunk_id"), "symbol_id", "kind", *FILE, "ord", "text", "start_line", end.cast("int").alias("end_line"), F.sha2("text", 256).alias("content_hash"))


def names_of(pairs: DataFrame, key: str, name: str, most: int, label: str) -> DataFrame:
    """key, label: up to ``most`` distinct sorted names, comma-joined."""
    return pairs.groupBy(key).agg(F.array_join(F.slice(F.array_sort(F.collect_set(name)), 1, most), ", ").alias(label))


def doc_line(doc):
    """What a header shows of a documentation: the start of its first line."""
    return F.substring(F.substring_index(F.btrim(doc, F.lit(" \t\n\v\f\r")), "\n", 1), 1, HEADER_DOC)


def headers(chunks: DataFrame, symbols: DataFrame, imports: DataFrame, called: DataFrame) -> DataFrame:
    """``chunks`` with context_header and input_hash.

    Lines: file and service; symbol with kind, roles and parent; imports; first line of the
    documentation; calls. Empty ones are left out; an unknown symbol has the first two only.
    ``symbols``: symbol_id, qualified_name, kind, roles, parent, doc (or ``doc_line`` of it);
    ``imports``: service, relpath, name; ``called``: symbol_id, name.

    Lines are made for the symbols, which are few columns without texts, so that a text is moved once
    at most; names are gathered for the files and symbols that occur only.
    """
    if "doc_line" not in symbols.columns:
        symbols = symbols.withColumn("doc_line", doc_line(F.col("doc"))).drop("doc")
    places = cut(chunks.select("symbol_id", "service", "relpath").distinct())
    owned = cut(places.join(symbols, "symbol_id"))
    files, own = cut(owned.select("service", "relpath").distinct()), owned.select("symbol_id").distinct()
    names = imports.join(files, ["service", "relpath"], "left_semi").select("service", "relpath", "name").distinct()
    i = names.groupBy("service", "relpath").agg(F.array_join(F.slice(F.array_sort(F.collect_set("name")), 1, HEADER_IMPORTS), ", ").alias("__imports"))
    c = names_of(called.join(own, "symbol_id", "left_semi"), "symbol_id", "name", HEADER_CALLS, "__calls")
    known = F.col("qualified_name").isNotNull()
    roles = F.when(F.size("roles") > 0, F.concat(F.lit(", "), F.array_join("roles", ", "))).otherwise("")
    symbol = F.when(known, F.concat(F.lit("symbol: "), "qualified_name", F.lit(" ("), "kind", roles, F.lit(")"), F.coalesce(F.concat(F.lit(" in "), "parent"), F.lit("")))).otherwise(F.concat(F.lit("symbol: "), "symbol_id"))
    line = lambda label, value: F.when(known & (F.coalesce(value, F.lit("")) != ""), F.concat(F.lit(label + ": "), value))
    owned = owned.join(i, ["service", "relpath"], "left").join(c, "symbol_id", "left")
    lines = F.array(symbol, line("imports", F.col("__imports")), line("doc", F.col("doc_line")), line("calls", F.col("__calls")))
    made = cut(owned.select(*(F.col(c).alias(f"__{c}") for c in ("symbol_id", "service", "relpath")), lines.alias("__lines")))
    at = (F.col("symbol_id") == F.col("__symbol_id")) & F.col("service").eqNullSafe(F.col("__service")) & F.col("relpath").eqNullSafe(F.col("__relpath"))
    place = F.concat(F.lit("file: "), "relpath", F.lit(" · service: "), "service")
    unknown = F.array(F.concat(F.lit("symbol: "), "symbol_id"))
    out = chunks.join(made, at, "left").withColumn("context_header", F.concat_ws("\n", place, F.coalesce("__lines", unknown)))
    return out.withColumn("input_hash", F.sha2(F.concat("context_header", F.lit("\n\n"), "text"), 256)).select(*chunks.columns, "context_header", "input_hash")


def missing_vectors(chunks: DataFrame, model: str) -> DataFrame:
    """Chunks without a vector, or with one of another model or of another input."""
    fresh = F.col("embedding").isNotNull() & F.col("embed_model").eqNullSafe(F.lit(model)) & F.col("embedded_hash").eqNullSafe(F.col("input_hash"))
    return chunks.where(~fresh)


def from_cache(missing: DataFrame, cache: DataFrame, model: str, dim: int) -> DataFrame:
    """``missing`` (chunk_id, input_hash) with the cached vector of this model and length, or null."""
    usable = cache.where((F.col("embed_model") == model) & (F.col("dim") == dim) & (F.size("vec") == dim)).select("input_hash", F.col("vec").alias("embedding"))
    return missing.select("chunk_id", "input_hash").join(usable.dropDuplicates(["input_hash"]), "input_hash", "left")


def embed_missing(chunks: DataFrame, cache: DataFrame, embedder, model: str, dim: int) -> tuple[DataFrame, DataFrame]:
    """(chunks with vectors, rows to add to the cache). Texts are embedded once per input hash, in Arrow batches.

    ``embedder`` gives doubles; they are kept in the type that ``embedding`` has.
    """
    kept = chunks.where(F.col("embedding").isNotNull() & F.col("embed_model").eqNullSafe(F.lit(model)) & F.col("embedded_hash").eqNullSafe(F.col("input_hash")))
    looked = from_cache(missing_vectors(chunks, model), cache, model, dim)
    todo = looked.where("embedding IS NULL").select("input_hash").distinct()
    texts = chunks.select("input_hash", F.concat("context_header", F.lit("\n\n"), "text").alias("text")).join(todo, "input_hash", "left_semi").dropDuplicates(["input_hash"])
    made = texts.mapInArrow(embedder, "input_hash string, vec array<double>").withColumn("vec", F.col("vec").cast(chunks.schema["embedding"].dataType))
    vectors = looked.join(made, "input_hash", "left").select("chunk_id", F.coalesce("embedding", "vec").alias("v"))
    rest = chunks.join(vectors, "chunk_id").withColumns({"embedding": F.col("v"), "embed_model": F.lit(model), "embedded_hash": F.col("input_hash")}).select(*chunks.columns)
    return kept.unionByName(rest), made.select("input_hash", F.lit(model).alias("embed_model"), F.lit(dim).alias("dim"), "vec")


def hash_embedder(dim: int = 8):
    """A deterministic stand-in for a model: SHA-256 of text and counter, as signed unit vectors."""

    def run(batches):
        import hashlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                raw = b"".join(hashlib.sha256(f"{text}\0{n}".encode()).digest() for n in range(-(-dim // 8)))
                v = np.frombuffer(raw, ">u4")[:dim].astype(np.float64) / 0xFFFFFFFF * 2 - 1
                out.append(v / np.sqrt(np.cumsum(v * v)[-1]))  # summed in order
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.float64()))], names=["input_hash", "vec"])

    return run
