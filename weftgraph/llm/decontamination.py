"""Benchmark decontamination: size-partitioned MinHash containment search, then exact shingle containment.

A test item is some dozens of words and a document may be thousands, so their Jaccard similarity
is near zero and a sketch of the document would lose the item. Containment is therefore searched
the asymmetric way: only the items are sketched, and every shingle of every document is looked up
among the sketches. Items are partitioned by size, and the size sets the sketch: of an item of q
distinct shingles the q - ceil(t q) + 1 with the smallest hashes are kept (bottom-k MinHash). A
document that holds a share t of the item holds at least one of these, whatever the item, so the
search loses nothing. Candidates are then verified by exact containment of the shingle strings.

Words are the maximal runs of letters and digits of the lower-cased text. Items of fewer than five
words form one shingle of all their words and are looked up among document shingles of that width.

Scale: documents are never shuffled for the search; their shingle hashes meet the sketches, which
Spark broadcasts only if their known size is under the session's threshold. Candidates are
aggregated per (document, item) before they are shuffled, and are written out. To verify them, texts
without a candidate are dropped before any shuffle as long as the candidates' keys number at most
``common.MOST_KEYS``; beyond that the texts are exchanged once.

Defined cases: a null text or item has no words and never matches; rows with equal id and text
give one row per item; a null id is carried as such; empty tables give an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import fresh, only
from weftgraph.session import cut

#: Words in a shingle, and the share of an item's distinct shingles that makes a leak.
WIDTH, SHARE = 5, 0.8


def words_of(text: Column) -> Column:
    plain = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "))
    return F.when(plain != "", F.split(plain, " ")).otherwise(F.array().cast("array<string>"))


def shingles(words: Column, width: int, joined) -> Column:
    """``joined`` of each ``width`` consecutive words; none if there are fewer."""
    starts = F.when(F.size(words) >= width, F.sequence(F.lit(0), F.size(words) - width)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: joined(*(F.get(words, i + k) for k in range(width))))


def spelled(words: Column, width: int) -> Column:
    return F.array_distinct(shingles(words, width, lambda *w: F.concat_ws(" ", *w)))


def hashed(words: Column, width: int) -> Column:
    return shingles(words, width, lambda *w: F.xxhash64(*w))


def prepare_items(items: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    words = items.select(F.col(id_col).alias("item_id"), words_of(F.col(text_col)).alias("words")).where("size(words) > 0")
    by_width = lambda make: F.coalesce(*(F.when(F.least(F.size("words"), F.lit(width)) == w, make(w)) for w in range(1, width + 1)))
    out = words.select(
        "item_id",
        F.least(F.size("words"), F.lit(width)).alias("width"),
        by_width(lambda w: spelled(F.col("words"), w)).alias("shingles"),
        by_width(lambda w: F.array_sort(F.array_distinct(hashed(F.col("words"), w)))).alias("hashes"),
    )
    return out.withColumn("q", F.size("shingles"))


def leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    width: int = WIDTH,
    share: float = SHARE,
) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_found, containment``: a row for each document and item it holds."""
    found = verified(docs, items, id_col, text_col, item_id_col, item_text_col, width, share)
    out = found.groupBy("doc_id", "item_id").agg(F.max("q").cast("int").alias("n_shingles"), F.max("n").cast("int").alias("n_found"))
    return out.withColumn("containment", F.round(F.col("n_found") / F.col("n_shingles"), 6))


def without_leaks(docs: DataFrame, items: DataFrame, width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """The rows of ``docs`` whose text holds no item; they are told by their text, so a null id is no refuge."""
    [key] = fresh(docs, "text_key")
    leaky = verified(docs, items, "doc_id", "text", "item_id", "text", width, share).select(F.col("text_key").alias(key)).distinct()
    return docs.join(cut(leaky), F.xxhash64(docs["text"]) == F.col(key), "left_anti")


def verified(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_id_col: str, item_text_col: str, width: int, share: float) -> DataFrame:
    """``doc_id, text_key, item_id, q, n``: candidates of the search that hold enough of the item's shingles."""
    prepared = prepare_items(items, item_id_col, item_text_col, width)
    need = F.ceil(F.lit(share) * F.col("q") - F.lit(1e-9)).cast("int")
    prepared = prepared.withColumn("need", need)
    sketch = (
        prepared.select("item_id", "width", F.explode(F.slice("hashes", F.lit(1), F.col("q") - F.col("need") + 1)).alias("h"))
        .groupBy("width", "h")
        .agg(F.collect_set("item_id").alias("items"))
    )
    text = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    widths = sorted(r.width for r in prepared.select("width").distinct().collect())  # at most ``width`` numbers
    found = None
    for w in widths:
        mine = text.select("doc_id", F.xxhash64("text").alias("text_key"), words_of(F.col("text")).alias("words"))
        mine = mine.select("doc_id", "text_key", F.explode(hashed(F.col("words"), w)).alias("h"))
        one = mine.join(sketch.where(F.col("width") == w).select("h", "items"), "h").select("doc_id", "text_key", F.explode("items").alias("item_id"))
        found = one if found is None else found.unionByName(one)
    if found is None:
        nothing = text.limit(0).select("doc_id", F.xxhash64("text").alias("text_key"))
        return nothing.select("*", F.lit(None).cast("bigint").alias("item_id"), F.lit(0).alias("q"), F.lit(0).alias("n"))
    pairs = cut(found.distinct().groupBy("doc_id", "text_key").agg(F.collect_set("item_id").alias("candidates")))
    held = only(text.withColumn("text_key", F.xxhash64("text")), "text_key", cut(pairs.select("text_key").distinct())).join(
        pairs.withColumnsRenamed({"doc_id": "c_id", "text_key": "c_key"}),
        (F.col("text_key") == F.col("c_key")) & F.col("doc_id").eqNullSafe(F.col("c_id")),
    )
    held = held.select("doc_id", "text_key", "candidates", words_of(F.col("text")).alias("words"))
    held = held.select("doc_id", "text_key", "candidates", *(spelled(F.col("words"), w).alias(f"s{w}") for w in widths))
    one = held.select("doc_id", "text_key", *(f"s{w}" for w in widths), F.explode("candidates").alias("item_id"))
    one = one.join(prepared.select("item_id", "width", "shingles", "q", "need"), "item_id")
    mine = F.coalesce(*(F.when(F.col("width") == w, F.col(f"s{w}")) for w in widths))
    return one.select("doc_id", "text_key", "item_id", "q", "need", F.size(F.array_intersect("shingles", mine)).alias("n")).where("n >= need").drop("need")


def op7_decontamination(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), ' ') AS w FROM documents
), b AS (
  SELECT item_id, string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), ' ') AS w FROM benchmark
), ds AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)
), bs AS (
  SELECT DISTINCT item_id, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT item_id, w, unnest(range(1, len(w) - 3)) AS i FROM b)
), q AS (
  SELECT item_id, count(*) AS q FROM bs GROUP BY item_id
), n AS (
  SELECT doc_id, item_id, count(*) AS n FROM ds JOIN bs USING (s) GROUP BY doc_id, item_id
)
SELECT doc_id, item_id, q::INT AS n_shingles, n::INT AS n_found, round(n / q, 6) AS containment
FROM n JOIN q USING (item_id) WHERE n >= ceil(0.8 * q - 1e-9)
"""
