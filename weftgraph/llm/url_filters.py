"""URL filters: host-suffix and path-prefix expressions, matched by short hash prefix and then by full digest.

A URL is expanded only into the shapes (label count, path length) that some rule has, so the
expansion is bounded by the rule table and not by the URL. The expressions equi-join the rules on
the first 32 bits of their SHA-256; the full digest then confirms, and the longest rule that fits
decides (a block wins over an allow of the same length, then the smaller rule string).

The rule side has one row per hash prefix. Spark broadcasts it only if its known size is under the
session's threshold; else both sides are shuffled, and adaptive skew handling splits a hot host,
which is legal since only the URL side is preserved.

Defined cases: a null URL or one without ``://`` has an empty host and path and gets the default
verdict; an empty table gives an empty result; repeated rows are each returned; other columns of
the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import ascii_lower, values

#: The rules of the query.
RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def digest(expression: Column) -> Column:
    return F.sha2(expression, 256)


def prepare_rules(rules: DataFrame) -> DataFrame:
    """One row per hash prefix, with the rules that share it. Unusable rules (a null, or no host) are left out."""
    r = rules.select("host", "path", "verdict").where("host IS NOT NULL AND host != '' AND path IS NOT NULL AND verdict IN ('allow', 'block')")
    r = r.select(F.concat(ascii_lower(F.col("host")), "path").alias("rule"), "verdict")
    one = r.groupBy("rule").agg(F.max("verdict").alias("verdict"))  # block sorts after allow
    return (
        one.select(F.substring(digest(F.col("rule")), 1, 8).alias("prefix"), F.struct(digest(F.col("rule")).alias("digest"), "rule", "verdict").alias("r"))
        .groupBy("prefix")
        .agg(F.collect_list("r").alias("rules"))
    )


def rule_shapes(rules: DataFrame) -> list[tuple[int, int]]:
    """The distinct (labels in the host, characters in the path) among the rules: at most a few hundred rows."""
    shape = rules.where("host IS NOT NULL AND host != '' AND path IS NOT NULL").select(F.size(F.split("host", "\\.")).alias("labels"), F.length("path").alias("chars"))
    return sorted((x.labels, x.chars) for x in shape.distinct().collect())


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """``id_col, host, path, rule, verdict``: a row for each row of ``pages``; ``rule`` is null if none fits."""
    host, path = host_and_path(F.col(url_col))
    base = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    labels = F.split("host", "\\.")
    shaped = [
        F.when(
            (F.size(labels) >= k) & (F.length("path") >= n),
            F.concat(F.array_join(F.slice(labels, -k, k), "."), F.substring("path", 1, n)),
        )
        for k, n in rule_shapes(rules)
    ] or [F.lit(None).cast("string")]
    spread = base.select("id", "host", "path", F.posexplode(F.array(*shaped)).alias("pos", "expression"))
    spread = spread.select("id", "host", "path", "pos", digest(F.col("expression")).alias("digest"))
    spread = spread.withColumn("prefix", F.substring("digest", 1, 8))
    met = spread.join(prepare_rules(rules), "prefix", "left")
    sure = F.get(F.filter("rules", lambda r: r["digest"] == F.col("digest")), F.lit(0))
    met = met.select("id", "host", "path", "pos", sure.alias("hit"))
    # the smallest rank wins: the longest rule, then a block, then the smaller string
    rank = F.struct((-F.length("hit.rule")).alias("a"), (F.col("hit.verdict") != "block").alias("b"), F.col("hit.rule").alias("c"))
    best = met.groupBy("id", "host", "path").agg(
        F.min(F.when(F.col("hit").isNotNull(), F.struct(rank.alias("rank"), F.col("hit.verdict").alias("verdict")))).alias("best"),
        F.sum(F.when(F.col("pos") == 0, 1).otherwise(0)).cast("int").alias("copies"),
    )
    best = best.select("*", F.explode(F.array_repeat(F.lit(0), F.col("copies"))).alias("copy"))
    return best.select(
        F.col("id").alias(id_col), "host", "path", F.col("best.rank.c").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )


def op1_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return judge(pages, values(spark, RULES, "host string, path string, verdict string"))


ORACLE = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT row_number() OVER () AS n, page_id,
         translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(h, p, verdict) AS (
  VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')
), met AS (
  SELECT n, page_id, host, path, h || p AS rule, verdict,
         row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC, verdict DESC, h || p) AS k
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM met WHERE k = 1
"""
