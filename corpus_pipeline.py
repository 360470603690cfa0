"""A corpus pipeline of five stages; each works on all that the one before it kept.

Each stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``docs``. Stages
keep rows with null ids unless their text is rejected; rows of one id and text count as one document
in the near-duplicate stage, and rows of one id whose texts are unlike as several. Empty tables pass
through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.llm import decontamination, language_id, packing, secret_scan, simhash
from weftgraph.llm.common import fresh
from weftgraph.session import cut, table, uncut

#: A document goes if it has no letter, or if it has LEAST_LETTERS and less than LEAST_KNOWN of its
#: n-grams are met in the learned languages: texts in those have 0.8 to 1, those in others 0 to 0.7.
LEAST_LETTERS, LEAST_KNOWN = 20, 0.7
#: Near duplicates: sets of five-word shingles of Jaccard similarity 0.8 or more, each link confirmed by the sets.
NEAR = {"width": 5, "ratio": 0.8}
#: Words that a packing worker remembers: fewer than in packing alone, as its executor's heap has been filled by the stages before.
WORDS = 200_000


def language(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    seen, (lang, _, known) = language_id.identify(docs, language_id.train(docs))
    foreign = (F.col(known) < LEAST_KNOWN) & (F.length(F.regexp_replace("text", r"\P{L}", "")) >= LEAST_LETTERS)
    return seen.where((F.col(lang) != language_id.UNKNOWN) & ~foreign).select(*docs.columns)


def near_duplicates(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays: of the smallest id, and of its texts and rows one."""
    found = simhash.near_copies(docs, **NEAR).where("doc_id IS NOT NULL")
    stays = found.groupBy("component").agg(F.min(F.struct("doc_id", "text_key")).alias("s")).select("s.*")
    known, (key, nth) = docs.where("doc_id IS NOT NULL"), fresh(docs, "text_key", "nth")
    known = known.withColumn(key, F.xxhash64("text")).join(stays.withColumnRenamed("text_key", key), ["doc_id", key], "left_semi")
    once = F.row_number().over(Window.partitionBy("doc_id", key).orderBy(F.lit(1)))
    known = known.withColumn(nth, once).where(F.col(nth) == 1).select(*docs.columns)
    return known.unionByName(docs.where("doc_id IS NULL"))


def benchmark_leaks(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def secrets(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact(docs)


def pack(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = packing.pack_documents(docs, packing.default_tokenizer(), word_memory=WORDS)
    return packing.digests(pieces)


STAGES = [
    ("language_id", language),
    ("simhash_near_dedup", near_duplicates),
    ("decontamination", benchmark_leaks),
    ("secret_scan", secrets),
    ("packing", pack),
]
#: SQL cannot express a trained classifier, SimHash with this hash, or a tokenizer.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    docs, kept = table(spark, sf_dir, "documents"), []
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = cut(docs)
            uncut(*kept)
            kept = [docs]
    return docs
