"""Further queries: budgets, caps, set operations, lookups, singletons, entry graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftgraph.operators import calls, chunks, graph, link, processes, search, staging
from weftgraph.plans import q_graph, q_search
from weftgraph.plans.registry import query
from weftgraph.session import table
from weftgraph.sources import testgraph
from weftgraph.sources.testgraph import oracle


@query("c4_cls_construction", "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 AND p_size > 10 THEN 'm/' || p_brand || '#' END AS dst FROM part")
def c4(spark, sf):
    p = table(spark, sf, "part")
    cls = F.concat(F.lit("m/"), "p_brand", F.lit("#"))
    sites = p.select(F.col("p_partkey").alias("id"), F.concat(F.when(F.col("p_size") > 10, cls).otherwise("m/none#"), F.lit("make()."), F.when(F.col("p_size") % 3 == 0, "(cls)").otherwise("(self)")).alias("symbol"))
    return calls.cls_construction(sites, p.select(cls.alias("symbol"))).select("id", "dst")


@query("c16_singletons", """
WITH s AS (SELECT 'n' || CASE WHEN p_partkey % 7 = 0 THEN p_partkey - 1 ELSE p_partkey END AS name, 'm' || (p_size % 5) AS module, p_brand AS class_name, 'sym/' || p_brand || '#' AS class_symbol FROM part),
u AS (SELECT name, min(module) AS origin, min(class_name) AS class_name, min(class_symbol) AS class_symbol FROM s GROUP BY name HAVING count(DISTINCT (module, class_name)) = 1),
m AS (SELECT CASE WHEN p_size % 2 = 0 THEN 'sym/' ELSE 'alt/' END || p_brand || '#' || lower(p_type) || '().' AS symbol, p_brand AS class_name, lower(p_type) AS method FROM part),
site AS (SELECT event_id, 'm' || (user_id % 5) AS module, 'n' || (event_id % 1999) AS receiver, CASE event_id % 3 WHEN 0 THEN 'economy' WHEN 1 THEN 'small' ELSE 'promo' END AS callee FROM events),
j AS (SELECT event_id, class_symbol || callee || '().' AS symbol, class_name, callee FROM site JOIN u ON receiver = name WHERE module = origin OR event_id % 4 = 0),
o AS (SELECT class_name, method, count(*) AS n, min(symbol) AS sole FROM m GROUP BY ALL)
SELECT event_id AS call_id, CASE WHEN j.symbol IN (SELECT symbol FROM m) THEN j.symbol ELSE sole END AS target, CASE WHEN j.symbol IN (SELECT symbol FROM m) THEN 1.0 ELSE 0.6 END::DOUBLE AS tier
FROM j LEFT JOIN o ON o.class_name = j.class_name AND o.method = callee WHERE j.symbol IN (SELECT symbol FROM m) OR n = 1""")
def c16(spark, sf):
    p = table(spark, sf, "part")
    single = p.select(F.lit("s").alias("service"), F.concat(F.lit("n"), F.when(F.col("p_partkey") % 7 == 0, F.col("p_partkey") - 1).otherwise(F.col("p_partkey"))).alias("name"), F.concat(F.lit("m"), F.col("p_size") % 5).alias("module"), F.col("p_brand").alias("class_name"), F.concat(F.lit("sym/"), "p_brand", F.lit("#")).alias("class_symbol"))
    methods = p.select(F.lit("s").alias("service"), F.concat(F.when(F.col("p_size") % 2 == 0, "sym/").otherwise("alt/"), "p_brand", F.lit("#"), F.lower("p_type"), F.lit("().")).alias("symbol"), F.col("p_brand").alias("class_name"), F.lower("p_type").alias("method"))
    e = table(spark, sf, "events")
    callee = F.when(F.col("event_id") % 3 == 0, "economy").when(F.col("event_id") % 3 == 1, "small").otherwise("promo")
    sites = e.select(F.col("event_id").alias("call_id"), F.lit("s").alias("service"), F.concat(F.lit("m"), F.col("user_id") % 5).alias("module"), F.concat(F.lit("n"), F.col("event_id") % 1999).alias("receiver"), callee.alias("callee"))
    # every fourth site imports its receiver from wherever it may be defined
    at = sites.where("call_id % 4 = 0").select("service", "module", F.col("receiver").alias("name"))
    imports = at.join(single.select("name", F.col("module").alias("target")).distinct(), "name")
    own = sites.where("call_id % 4 != 0")
    keyed = sites.where("call_id % 4 = 0")
    return calls.singleton_targets(own, single, imports.limit(0), methods).unionByName(calls.singleton_targets(keyed, single, imports, methods))


@query("c19_selector_resolve", oracle("""SELECT service || ':' || name AS selector, min(id) AS entry FROM g_nodes WHERE kind = 'Class' GROUP BY ALL
  UNION ALL SELECT service || ':get /' || CAST(o_orderkey AS VARCHAR), id FROM ord WHERE o_orderkey % 20 = 0 UNION ALL SELECT 'none:' || r_name, NULL FROM region"""))
def c19(spark, sf):
    n = testgraph.nodes(spark, sf)
    cls = n.where("kind = 'Class'").select(F.concat("service", F.lit(":"), "name").alias("selector")).distinct()
    orders = n.where("id LIKE '%:order/%'").withColumn("k", F.substring_index("id", "/", -1)).where("k % 20 = 0")
    by_route = orders.select(F.concat("service", F.lit(":get /"), "k").alias("selector"))
    lost = table(spark, sf, "region").select(F.concat(F.lit("none:"), "r_name").alias("selector"))
    handles = orders.select(F.concat(F.lit("chan:http:"), "service", F.lit(":GET /"), "k").alias("src"), F.col("id").alias("dst"), F.lit("HANDLES").alias("type"))
    declared = cls.unionByName(by_route).unionByName(lost).withColumn("name", F.col("selector"))
    return processes.resolve(declared, n.where("kind = 'Class'").withColumn("qualified_name", F.col("name")), handles).select("selector", "entry")


@query("e3_best_chunk", "SELECT question, id, group_key, siblings FROM (SELECT vec_id % 30 AS question, vec_id AS id, label AS group_key, row_number() OVER (PARTITION BY vec_id % 30, label ORDER BY embedding[1] DESC, vec_id) AS k, (count(*) OVER (PARTITION BY vec_id % 30, label) - 1)::BIGINT AS siblings FROM embeddings) WHERE k = 1")
def e3(spark, sf):
    e = table(spark, sf, "embeddings").select((F.col("vec_id") % 30).alias("question"), F.col("vec_id").alias("id"), F.get("embedding", F.lit(0)).cast("double").alias("score"), F.col("label").cast("string").alias("symbol"))
    best = search.by_symbol(e.drop("symbol"), e.select("id", "symbol"), 10_000)
    return best.select("question", "id", F.col("symbol").cast("int").alias("group_key"), F.col("sibling_chunks").alias("siblings"))


@query("e5_rrf_terms", "SELECT l_orderkey AS question, l_linenumber AS id, round(sum(1.0::DOUBLE / (60 + k)), 8) AS score FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS k FROM lineitem) GROUP BY ALL")
def e5(spark, sf):
    nth = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")) - 1
    return search.rrf(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("question"), F.col("l_linenumber").alias("id"), nth.alias("rank")))


BUDGET = """
two AS (SELECT src AS a, type AS t, dst AS b, 'out' AS d FROM g_edges UNION ALL SELECT dst, type, src, 'in' FROM g_edges),
r AS (SELECT id AS start, id AS node, 0 AS level FROM g_nodes WHERE kind = 'Module' UNION ALL SELECT DISTINCT r.start, two.b, 1 FROM r JOIN two ON two.a = r.node WHERE level = 0 AND two.b <> r.start),
h AS (SELECT start, level, a, t, b, d, row_number() OVER (PARTITION BY start ORDER BY level, a, d = 'in', t, b) AS k FROM r JOIN two ON two.a = r.node)"""


@query("f3_hop_budget", oracle("SELECT start, level, a AS node, t AS edge_type, b AS neighbor, d AS direction FROM h WHERE k <= 30", BUDGET))
def f3(spark, sf):
    e = testgraph.edges(spark, sf)
    hops, _ = graph.expand(e, testgraph.nodes(spark, sf).where("kind = 'Module'"), None, "both", 2, 30)
    return hops.select("start", "level", F.col("at").alias("node"), "edge_type", "neighbor", "direction")


@query("f3_truncated", oracle("SELECT start, max(k) > 30 AS truncated FROM h GROUP BY start", BUDGET))
def f3_truncated(spark, sf):
    _, over = graph.expand(testgraph.edges(spark, sf), testgraph.nodes(spark, sf).where("kind = 'Module'"), None, "both", 2, 30)
    return over


@query("f7_header_caps", "SELECT user_id, array_to_string(list(DISTINCT props ORDER BY props)[1:5], ', ') AS names FROM events GROUP BY user_id")
def f7(spark, sf):
    return chunks.names_of(table(spark, sf, "events"), "user_id", "props", chunks.HEADER_CALLS, "names")


@query("f8_member_cap", oracle("SELECT process, count(*)::BIGINT AS members, max(k - 1)::INT AS last FROM (SELECT user_id AS process, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM ev) WHERE k <= 20 GROUP BY process"))
def f8(spark, sf):
    e = testgraph.edges(spark, sf).where("type = 'CALLS'")
    first = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    d = table(spark, sf, "events").withColumn("k", first).where("k = 1").select(F.col("user_id").alias("process"), F.concat(F.lit("sym:user"), "user_id", F.lit(":event/"), "event_id").alias("entry"))
    return link.part_of_process(e, d, 20).groupBy("process").agg(F.count(F.lit(1)).alias("members"), F.max("order").alias("last"))


@query("g1_both_directions", oracle("SELECT id, direction, count(*)::BIGINT AS n FROM (SELECT src AS id, 'out' AS direction FROM g_edges UNION ALL SELECT dst, 'in' FROM g_edges) WHERE id LIKE '%customer%' GROUP BY ALL"))
def g1(spark, sf):
    ids = testgraph.nodes(spark, sf).where("id LIKE '%customer%'")
    return graph.neighbors(testgraph.edges(spark, sf), ids).groupBy("id", "direction").agg(F.count(F.lit(1)).alias("n"))


@query("g2_frontier_difference", oracle("SELECT DISTINCT dst AS node FROM g_edges WHERE type = 'CONTAINS' AND dst NOT IN (SELECT src FROM g_edges WHERE type = 'CONTAINS')"))
def g2(spark, sf):
    e = testgraph.edges(spark, sf).where("type = 'CONTAINS'")
    front = e.select(F.lit("all").alias("start"), F.col("dst").alias("node"))
    return graph.unseen(front, e.select(F.lit("all").alias("start"), F.col("src").alias("node"))).select("node")


@query("g3_found_and_golden", oracle("SELECT src, dst FROM g_edges WHERE type = 'CONSUMES' AND confidence >= 0.8 INTERSECT SELECT src, dst FROM g_edges WHERE type = 'CONSUMES' AND evidence_line < 4"))
def g3(spark, sf):
    e = testgraph.edges(spark, sf).where("type = 'CONSUMES'")
    return e.where("confidence >= 0.8").select("src", "dst").intersect(e.where("evidence_line < 4").select("src", "dst"))


@query("g3_found_not_golden", oracle("SELECT src, dst FROM g_edges WHERE type = 'CONSUMES' AND confidence >= 0.8 EXCEPT SELECT src, dst FROM g_edges WHERE type = 'CONSUMES' AND evidence_line < 4"))
def g3_minus(spark, sf):
    e = testgraph.edges(spark, sf).where("type = 'CONSUMES'")
    return e.where("confidence >= 0.8").select("src", "dst").subtract(e.where("evidence_line < 4").select("src", "dst"))


@query("i10_entry_graph", oracle("""SELECT DISTINCT p.dst AS entry, n.dst AS next FROM n_next n JOIN (SELECT dst AS c, min(src) AS dst FROM g_edges WHERE type = 'CONTAINS' AND src NOT LIKE 'chan:%' GROUP BY dst) p ON p.c = n.src""", q_graph.NEXT))
def i10(spark, sf):
    e = testgraph.edges(spark, sf)
    producers = e.where("type IN ('PRODUCES', 'CALLS_HTTP')").select(F.col("src").alias("id")).distinct()
    up = e.where("type = 'CONTAINS' AND src NOT LIKE 'chan:%'")
    owner = graph.climb(up, producers, testgraph.nodes(spark, sf).where("kind = 'Module'"))
    return link.next_of_owners(e, owner.select(F.col("start").alias("node"), F.col("top").alias("owner"))).withColumnRenamed("owner", "entry")


@query("m2_two_pass", f"WITH asked AS (SELECT p_partkey AS question, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' nosuchword' ELSE '' END AS text FROM part WHERE p_partkey % 20 = 0), {q_search.bm25('part', 'p_partkey', 'p_name', 'text', 6)} SELECT question, id, score, rank::INT AS rank FROM t_top")
def m2(spark, sf):
    p = table(spark, sf, "part")
    q = p.where("p_partkey % 20 = 0").select(F.col("p_partkey").alias("question"), F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " nosuchword").otherwise("")).alias("text"))
    return search.search_text(search.postings(p, "p_partkey", F.col("p_name")), q, 6)


@query("m3_service_filter", f"WITH {q_search.ASKED}, fr AS (SELECT * FROM documents WHERE lang = 'fr'), {q_search.bm25('fr', 'doc_id', 'text', 'text', 5)} SELECT question, id, score, rank::INT AS rank FROM t_top")
def m3_service(spark, sf):
    fr = table(spark, sf, "documents").where("lang = 'fr'")
    return search.search_text(search.postings(fr, "doc_id", F.col("text")), q_search.questions(spark, sf), 5)


@query("n4_escalation", "SELECT user_id AS service, sha256(string_agg(event_type, chr(10) ORDER BY event_type) FILTER (day(ts) < 15)) <> sha256(string_agg(event_type, chr(10) ORDER BY event_type) FILTER (day(ts) >= 15)) AS moved FROM events GROUP BY user_id HAVING count(*) FILTER (day(ts) < 15) > 0 AND count(*) FILTER (day(ts) >= 15) > 0")
def n4(spark, sf):
    e = table(spark, sf, "events").withColumnRenamed("user_id", "service")
    a = staging.ordered_digest(e.where(F.dayofmonth("ts") < 15), ["service"], [F.col("event_type")])
    b = staging.ordered_digest(e.where(F.dayofmonth("ts") >= 15), ["service"], [F.col("event_type")]).withColumnRenamed("digest", "later")
    return staging.moved(a, b.withColumnRenamed("later", "digest")).where("known").select("service", "moved")


@query("n6_begin_service", oracle("SELECT origin_service, count(*)::BIGINT AS n FROM g_edges WHERE origin_service <> 'EUROPE' GROUP BY ALL"))
def n6(spark, sf):
    e = testgraph.edges(spark, sf)
    gone = table(spark, sf, "region").where("r_name = 'EUROPE'").select(F.col("r_name").alias("service"))
    return staging.delete_file_layer(e, gone, {"origin_service": "service"}).groupBy("origin_service").agg(F.count(F.lit(1)).alias("n"))


@query("n9_update_props", "SELECT c_custkey AS id, CASE WHEN o.k IS NOT NULL THEN 'new' ELSE c_mktsegment END AS segment, c_name AS name FROM customer LEFT JOIN (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderkey % 4 = 0) o ON o.k = c_custkey")
def n9(spark, sf):
    c = table(spark, sf, "customer")
    n = c.select(F.col("c_custkey").alias("id"), F.array().cast("array<string>").alias("roles"), F.create_map(F.lit("segment"), F.col("c_mktsegment"), F.lit("name"), F.col("c_name")).alias("props"))
    patches = table(spark, sf, "orders").where("o_orderkey % 4 = 0").select(F.col("o_custkey").alias("id")).distinct().select("id", F.lit(None).cast("array<string>").alias("add_roles"), F.create_map(F.lit("segment"), F.lit("new")).alias("add_props"))
    return staging.patch_nodes(n, patches).select("id", F.col("props")["segment"].alias("segment"), F.col("props")["name"].alias("name"))


@query("n10_live_vectors", "SELECT count(*) > 0 AS live FROM documents JOIN embeddings ON vec_id = doc_id")
def n10(spark, sf):
    from weftgraph.plans.incremental import live_vectors

    c = q_search.corpus(spark, sf).withColumnRenamed("vector", "embedding")
    return spark.range(1).select(F.lit(live_vectors(c)).alias("live"))


@query("s2_module_set", "SELECT DISTINCT source || '.' || lang AS module FROM documents")
def s2(spark, sf):
    from weftgraph.functions.ids import relpath_to_module

    return table(spark, sf, "documents").select(relpath_to_module(F.concat("source", F.lit("/"), "lang", F.lit("/__init__.py"))).alias("module")).distinct()
