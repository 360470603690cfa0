"""Golden edges and questions from files, and how far a graph and its search meet them."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.api import Api
from weftgraph.operators import search
from weftgraph.operators.evaluate import hit_rank
from weftgraph.sources.config import parse_text

EDGE = "src_service string, src string, dst_service string, dst string, type string"


def golden_edges(spark: SparkSession, path: str, types: list[str]) -> DataFrame:
    """The distinct edges of a file that have one of ``types``, as ``evaluate.found_edges`` gives them.

    An end that is a channel is its id and has no service. Calls with a mechanism are left out. The
    file is written by hand, so it is read by the driver.
    """
    rows = set()
    for e in (parse_text(path, Path(path).read_text()) or {}).get("edges") or []:
        if e.get("type") in types and not (e["type"] == "CALLS" and "mechanism" in e):
            src, dst = e["src"], e["dst"]
            rows.add((src["service"], src["symbol"], *((None, dst["channel"]) if "channel" in dst else (dst["service"], dst["symbol"])), e["type"]))
    return spark.createDataFrame(sorted(rows, key=repr), EDGE)


def golden_questions(path: str) -> list[dict]:
    """question, accept (service, symbol of each) and k of each golden question."""
    return (parse_text(path, Path(path).read_text()) or {}).get("questions") or []


def retrieval(api: Api, questions: list[dict], mode: str = "hybrid") -> list[dict]:
    """question, hit, rank (from 0, none without a hit) of each question, in order; those of one k are searched in one batch.

    An accepted symbol must be of the result's service. Vectors are left out where there is no embedder.
    """
    spark, ranks = api.spark, {}
    used = mode if api.embed else "text"
    posted = search.postings(api.chunks, "id", F.col("text"))
    names = api.nodes.select(F.col("id").alias("symbol"), F.col("qualified_name").alias("name"))
    for k in sorted({q.get("k", 8) for q in questions}):
        batch = [(n, q["question"], list(map(float, api.embed(q["question"]))) if api.embed else None) for n, q in enumerate(questions) if q.get("k", 8) == k]
        asked = spark.createDataFrame(batch, "question int, text string, vector array<double>")
        accepted = spark.createDataFrame([(n, a["service"], a["symbol"]) for n, _, _ in batch for a in questions[n]["accept"]], "question int, service string, accept string")
        found = search.items(search.search_code(api.chunks, posted, asked, k, used), api.chunks).join(names, "symbol", "left")
        results = found.select("question", "rank", "service", F.col("chunk_kind").alias("kind"), F.col("name").alias("symbol"))
        ranks |= {r.question: r["rank"] for r in hit_rank(results, accepted).collect()}
    return [{"question": q["question"], "hit": ranks.get(n) is not None, "rank": ranks.get(n)} for n, q in enumerate(questions)]
