"""Queries of retrieval and of chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.operators import chunks, evaluate, search
from weftgraph.plans.registry import query
from weftgraph.session import table

K = 5


def questions(spark, sf):
    """Every twentieth item of the benchmark, with its whole text."""
    b = table(spark, sf, "benchmark").where("item_id % 20 = 0")
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))
    return b.select("item_id", "text").join(e, "item_id", "left").withColumnRenamed("item_id", "question")


def corpus(spark, sf):
    d = table(spark, sf, "documents")
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return d.join(e, "doc_id", "left").select(F.col("doc_id").alias("id"), F.col("source").alias("symbol"), F.col("lang").alias("service"), "text", "vector")


def posted(spark, sf):
    return search.postings(table(spark, sf, "documents"), "doc_id", F.col("text"))


def bm25(source: str, key: str, text: str, asked: str, k: int, name: str = "t") -> str:
    split = lambda x: f"list_filter(string_split_regex(lower({x}), '[^a-z0-9_]+'), lambda x: x <> '')"
    clean = f"""trim(regexp_replace(translate({asked}, '@{{}}()|-=~*:"''%[]', '                '), '\\s+', ' ', 'g'))"""
    return f"""
{name}_doc AS (SELECT {key} AS id, {split(text)} AS ts FROM {source}),
{name}_post AS (SELECT id, len(ts) AS dl, token, count(*) AS tf FROM (SELECT id, ts, unnest(ts) AS token FROM {name}_doc) GROUP BY ALL),
{name}_stat AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM (SELECT DISTINCT id, dl FROM {name}_post)),
{name}_q AS (SELECT question, list_distinct({split(clean)}) AS ts FROM asked),
{name}_qt AS (SELECT question, len(ts) AS wanted, unnest(ts) AS token FROM {name}_q),
{name}_df AS (SELECT token, count(*) AS df FROM {name}_post GROUP BY token),
{name}_hit AS (SELECT question, id, any_value(wanted) AS wanted, count(*) AS m,
  round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM {name}_post JOIN {name}_qt USING (token) JOIN {name}_df USING (token), {name}_stat GROUP BY question, id),
{name}_all AS (SELECT *, max(m = wanted) OVER (PARTITION BY question) AS has FROM {name}_hit),
{name}_top AS (SELECT question, id, score, k - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS k
  FROM {name}_all WHERE m = wanted OR (NOT has AND wanted >= 2)) WHERE k <= {k})"""


ASKED = "asked AS (SELECT item_id AS question, text, embedding AS vector FROM benchmark LEFT JOIN embeddings ON vec_id = item_id WHERE item_id % 20 = 0)"
NEAR = """
v_all AS (SELECT question, doc_id AS id, round(1 - list_sum(list_transform(list_zip(vector, embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))
  / (sqrt(list_sum(list_transform(vector, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) + 0.0::DOUBLE AS distance
  FROM asked, documents JOIN embeddings ON vec_id = doc_id WHERE vector IS NOT NULL),
v_top AS (SELECT question, id, distance, k - 1 AS rank FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY distance, id) AS k FROM v_all) WHERE k <= {k})"""
FUSED = """
fused AS (SELECT question, id, round(sum(1.0::DOUBLE / (61 + rank)), 8) AS score FROM ({legs}) GROUP BY question, id),
grouped AS (SELECT f.*, source AS symbol, row_number() OVER w AS nth, count(*) OVER (PARTITION BY question, source) - 1 AS sibling_chunks FROM fused f JOIN documents ON doc_id = id WINDOW w AS (PARTITION BY question, source ORDER BY score DESC, id)),
best AS (SELECT question, id, symbol, score, sibling_chunks, row_number() OVER (PARTITION BY question ORDER BY score DESC, id) - 1 AS rank FROM grouped WHERE nth = 1)"""
DOCS = lambda k: bm25("documents", "doc_id", "text", "text", k)
LEG_T, LEG_V = "SELECT question, id, rank FROM t_top", "SELECT question, id, rank FROM v_top"


@query("m3_search_text", f"WITH {ASKED}, {DOCS(K)} SELECT question, id, score, rank::INT AS rank FROM t_top")
def m3(spark, sf):
    return search.search_text(posted(spark, sf), questions(spark, sf), K)


@query("m1_search_symbols", f"WITH asked AS (SELECT p_partkey AS question, p_name || CASE WHEN p_partkey % 40 = 0 THEN '-(x)' ELSE '' END AS text FROM part WHERE p_partkey % 20 = 0), {bm25('part', 'p_partkey', 'p_name', 'text', 7)} SELECT question, id, score, rank::INT AS rank FROM t_top")
def m1(spark, sf):
    p = table(spark, sf, "part")
    q = p.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("question"), F.when(F.col("p_partkey") % 40 == 0, F.concat("p_name", F.lit("-(x)"))).otherwise(F.col("p_name")).alias("text"))
    return search.search_text(search.postings(p, "p_partkey", F.col("p_name")), q, 7)


@query("m5_exact_vectors", f"WITH {ASKED}, {NEAR.format(k=10)} SELECT question, id, distance, rank::INT AS rank FROM v_top")
def m5(spark, sf):
    return search.search_vectors(corpus(spark, sf).where("vector IS NOT NULL"), questions(spark, sf), 10)


@query("f4_vector_top_k", """
  SELECT id, distance FROM (SELECT v.vec_id AS id, round(1 - list_sum(list_transform(list_zip(v.embedding, q.embedding), lambda p: p[1]::DOUBLE * p[2]::DOUBLE))
  / (sqrt(list_sum(list_transform(v.embedding, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform(q.embedding, lambda x: x::DOUBLE * x::DOUBLE)))), 6) + 0.0::DOUBLE AS distance
  FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 7) q) ORDER BY distance, id LIMIT 10""")
def f4(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    q = e.where("id = 7").first()["vector"]
    return search.top_exact(e, F.array(*map(F.lit, q)).cast("array<float>"), 10)


@query("m6_rrf", f"WITH {ASKED}, {DOCS(20)}, {NEAR.format(k=20)}, {FUSED.format(legs=LEG_T + ' UNION ALL ' + LEG_V)} SELECT question, id, score FROM fused")
def m6(spark, sf):
    q = questions(spark, sf)
    return search.rrf(search.search_text(posted(spark, sf), q, 20), search.search_vectors(corpus(spark, sf).where("vector IS NOT NULL"), q, 20))


def code(spark, sf, mode):
    return search.search_code(corpus(spark, sf), posted(spark, sf), questions(spark, sf), K, mode)


@query("m8_search_code", f"WITH {ASKED}, {DOCS(20)}, {NEAR.format(k=20)}, {FUSED.format(legs=LEG_T + ' UNION ALL ' + LEG_V)} SELECT question, id, symbol, score, sibling_chunks::BIGINT AS sibling_chunks, rank::INT AS rank FROM best WHERE rank < {K}")
def m8(spark, sf):
    return code(spark, sf, "hybrid")


@query("m8_search_text_mode", f"WITH {ASKED}, {DOCS(20)}, {FUSED.format(legs=LEG_T)} SELECT question, id, symbol, score, sibling_chunks::BIGINT AS sibling_chunks, rank::INT AS rank FROM best WHERE rank < {K}")
def m8_text(spark, sf):
    return code(spark, sf, "text")


@query("m9_find_entrypoint", f"""
  WITH asked AS (SELECT vec_id AS question, p_name AS text, embedding AS vector FROM embeddings JOIN part ON p_partkey = vec_id WHERE vec_id % 20 = 0), {bm25('part', 'p_partkey', 'p_name', 'text', 20)},
  {NEAR.format(k=20)}, b AS (SELECT question, id % 100 AS id, min(rank) AS r FROM v_top GROUP BY ALL), bb AS (SELECT question, id, row_number() OVER (PARTITION BY question ORDER BY r) - 1 AS rank FROM b),
  f AS (SELECT question, id, round(sum(1.0::DOUBLE / (61 + rank)), 8) AS score FROM (SELECT question, id, rank FROM t_top UNION ALL SELECT question, id, rank FROM bb) GROUP BY question, id)
  SELECT question, id, score FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY score DESC, id) AS k FROM f) WHERE k <= {K}""")
def m9(spark, sf):
    p = table(spark, sf, "part")
    e = table(spark, sf, "embeddings").where("vec_id % 20 = 0")
    q = e.join(p, F.col("vec_id") == F.col("p_partkey")).select(F.col("vec_id").alias("question"), F.col("p_name").alias("text"), F.col("embedding").alias("vector"))
    own = corpus(spark, sf).withColumn("symbol", F.col("id") % 100)
    nodes = p.select(F.col("p_partkey").alias("id"), F.lit("Function").alias("kind"))
    return search.find_entrypoint(search.postings(p, "p_partkey", F.col("p_name")), own, q, nodes, None, K)


@query("d9_hit_rank", f"WITH {ASKED}, {DOCS(20)}, {FUSED.format(legs=LEG_T)}, g AS (SELECT item_id AS question, 'src' || (item_id % 50) AS accept FROM benchmark WHERE item_id % 20 = 0) SELECT g.question, (min(rank) + 1)::INT AS rank FROM g LEFT JOIN best b ON b.question = g.question AND b.rank < {K} AND symbol = accept GROUP BY g.question")
def d9(spark, sf):
    found = code(spark, sf, "text").select("question", (F.col("rank") + 1).alias("rank"), F.lit("Module").alias("kind"), "symbol")
    golden = table(spark, sf, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("question"), F.concat(F.lit("src"), F.col("item_id") % 50).alias("accept"))
    return evaluate.hit_rank(found, golden)


PACKED = r"""
d AS (SELECT doc_id, regexp_extract_all(text, '[^\n]*\n|[^\n]+$') AS lines FROM documents),
p AS (SELECT doc_id, 1 AS i, lines, ''::VARCHAR AS open, NULL::VARCHAR AS piece, 0 AS ord FROM d
  UNION ALL SELECT doc_id, i + 1, lines, CASE WHEN i > len(lines) THEN '' WHEN open = '' OR strlen(open) + strlen(lines[i]) <= 2000 THEN open || lines[i] ELSE lines[i] END,
    CASE WHEN i > len(lines) THEN open WHEN open <> '' AND strlen(open) + strlen(lines[i]) > 2000 THEN open END,
    ord + CASE WHEN piece IS NULL THEN 0 ELSE 1 END FROM p WHERE i <= len(lines) + 1),
pieces AS (SELECT doc_id, ord::INT AS ord, piece AS text FROM p WHERE piece IS NOT NULL AND piece <> '')"""


@query("e7_line_packing", f"WITH RECURSIVE {PACKED} SELECT * FROM pieces")
def e7(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.posexplode(chunks.pack_lines(F.col("text"))).alias("ord", "text"))


@query("l1_chunk_rows", f"""WITH RECURSIVE {PACKED}, b AS (SELECT *, strlen(text) - strlen(replace(text, chr(10), '')) AS breaks FROM pieces),
  l AS (SELECT *, coalesce(sum(breaks) OVER (PARTITION BY doc_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM b)
  SELECT doc_id::VARCHAR AS symbol_id, doc_id || '#c' || ord AS chunk_id, ord, (before + 1)::INT AS start_line, (before + breaks + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END)::INT AS end_line, sha256(text) AS content_hash FROM l""")
def l1(spark, sf):
    return chunks.chunk_rows(table(spark, sf, "documents"), "doc_id", "text").select("symbol_id", "chunk_id", "ord", "start_line", "end_line", "content_hash")


HEADER = """
i AS (SELECT o_custkey, list(DISTINCT o_orderpriority ORDER BY o_orderpriority)[1:8] AS names FROM orders GROUP BY o_custkey),
c AS (SELECT user_id, list(DISTINCT props ORDER BY props)[1:5] AS names FROM events GROUP BY user_id),
h AS (SELECT doc_id, text, 'file: f' || (doc_id % 300) || ' · service: s' || chr(10) || CASE WHEN c_custkey IS NULL THEN 'symbol: ' || doc_id ELSE
  'symbol: ' || c_name || ' (Class' || CASE WHEN c_custkey % 2 = 0 THEN ', ' || c_mktsegment ELSE '' END || ')' || CASE WHEN c_custkey % 3 = 0 THEN ' in nation' || c_nationkey ELSE '' END
  || CASE WHEN i.names IS NULL THEN '' ELSE chr(10) || 'imports: ' || array_to_string(i.names, ', ') END || CASE WHEN {DOC} = '' THEN '' ELSE chr(10) || 'doc: ' || substr(split_part({DOC}, chr(10), 1), 1, 120) END
  || CASE WHEN c.names IS NULL THEN '' ELSE chr(10) || 'calls: ' || array_to_string(c.names, ', ') END END AS header
  FROM documents LEFT JOIN customer ON c_custkey = doc_id AND doc_id % 7 <> 0 LEFT JOIN i ON o_custkey = doc_id % 300 LEFT JOIN c ON user_id = doc_id)"""


HEADER = HEADER.replace("{DOC}", "coalesce(trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '')")


@query("l2_headers", f"WITH {HEADER} SELECT doc_id::VARCHAR AS symbol_id, header AS context_header, sha256(header || chr(10) || chr(10) || text) AS input_hash FROM h")
def l2(spark, sf):
    d = table(spark, sf, "documents")
    rows = d.select(F.col("doc_id").cast("string").alias("symbol_id"), F.lit("s").alias("service"), F.concat(F.lit("f"), F.col("doc_id") % 300).alias("relpath"), "text")
    c = table(spark, sf, "customer").where("c_custkey % 7 != 0")
    own = c.select(F.col("c_custkey").cast("string").alias("symbol_id"), F.col("c_name").alias("qualified_name"), F.lit("Class").alias("kind"), F.when(F.col("c_custkey") % 2 == 0, F.array("c_mktsegment")).otherwise(F.array().cast("array<string>")).alias("roles"), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("nation"), "c_nationkey")).alias("parent"))
    own = own.join(d.select(F.col("doc_id").cast("string").alias("symbol_id"), chunks.doc_line(F.col("text")).alias("doc_line")), "symbol_id")
    imports = table(spark, sf, "orders").select(F.lit("s").alias("service"), F.concat(F.lit("f"), "o_custkey").alias("relpath"), F.col("o_orderpriority").alias("name"))
    called = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("symbol_id"), F.col("props").alias("name"))
    return chunks.headers(rows, own, imports, called).select("symbol_id", "context_header", "input_hash")


@query("l4_missing_vectors", "SELECT doc_id AS chunk_id FROM documents LEFT JOIN embeddings ON vec_id = doc_id WHERE vec_id IS NULL OR doc_id % 4 = 0 OR doc_id % 5 = 0")
def l4(spark, sf):
    c = corpus(spark, sf).select(F.col("id").alias("chunk_id"), F.col("vector").alias("embedding"), F.when(F.col("id") % 4 == 0, "old").otherwise("new").alias("embed_model"), F.when(F.col("id") % 5 == 0, "x").otherwise("h").alias("embedded_hash"), F.lit("h").alias("input_hash"))
    return chunks.missing_vectors(c, "new").select("chunk_id")


@query("l5_vector_cache", "SELECT doc_id AS chunk_id, vec_id IS NOT NULL AND doc_id % 3 <> 0 AS cached FROM documents LEFT JOIN embeddings ON vec_id = doc_id")
def l5(spark, sf):
    d = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").cast("string").alias("input_hash"))
    cache = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("input_hash"), F.when(F.col("vec_id") % 3 == 0, "other").otherwise("m").alias("embed_model"), F.lit(64).alias("dim"), F.col("embedding").alias("vec"))
    return chunks.from_cache(d, cache, "m", 64).select("chunk_id", F.col("embedding").isNotNull().alias("cached"))


@query("l6_embed_missing", """
  WITH h AS (SELECT doc_id, sha256('h' || chr(10) || chr(10) || text || chr(0) || '0') AS x FROM documents),
  v AS (SELECT doc_id, list_transform(range(8), lambda i: ('0x' || substr(x, (8 * i + 1)::BIGINT, 8))::BIGINT / 4294967295.0::DOUBLE * 2 - 1) AS v FROM h),
  n AS (SELECT doc_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm FROM v)
  SELECT doc_id AS chunk_id, 'm' AS embed_model, array_to_string(list_transform(v, lambda x: round(x / norm * 1000)::BIGINT), ',') AS vector FROM n""")
def l6(spark, sf):
    d = table(spark, sf, "documents")
    none = lambda kind: F.lit(None).cast(kind)
    c = d.select(F.col("doc_id").alias("chunk_id"), "text", F.lit("h").alias("context_header"), F.sha2("text", 256).alias("input_hash"), none("array<double>").alias("embedding"), none("string").alias("embed_model"), none("string").alias("embedded_hash"))
    cache = table(spark, sf, "embeddings").limit(0).select(F.lit("").alias("input_hash"), F.lit("m").alias("embed_model"), F.lit(8).alias("dim"), F.col("embedding").cast("array<double>").alias("vec"))
    done, _ = chunks.embed_missing(c, cache, chunks.hash_embedder(8), "m", 8)
    thousandths = F.transform("embedding", lambda x: F.round(x * 1000).cast("bigint").cast("string"))
    return done.select("chunk_id", "embed_model", F.array_join(thousandths, ",").alias("vector"))
