"""Row-wise queries and single-table queries: sources, projections, filters, scalar functions, aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftgraph.functions import ids, scalars
from weftgraph.operators import dedup, staging
from weftgraph.plans.registry import query
from weftgraph.session import table
from weftgraph.sources import testgraph
from weftgraph.sources.testgraph import oracle


@query("a1_scan_files", """
  SELECT source AS service, lpad(doc_id::VARCHAR, 8, '0') || '.py' AS relpath, sha256(text) AS sha256, strlen(text)::BIGINT AS size FROM documents""")
def a1(spark, sf):
    d = table(spark, sf, "documents")
    return d.select(F.col("source").alias("service"), F.concat(F.lpad(F.col("doc_id").cast("string"), 8, "0"), F.lit(".py")).alias("relpath"), F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("size"))


@query("a1_tree_hash", """
  SELECT source AS service, sha256(string_agg(lpad(doc_id::VARCHAR, 8, '0') || '.py:' || sha256(text), chr(10) ORDER BY doc_id)) AS tree_hash, count(*)::BIGINT AS files
  FROM documents GROUP BY source""")
def a1_tree(spark, sf):
    from weftgraph.sources.files import tree_hash

    return tree_hash(a1(spark, sf))


@query("a3_split_defs_refs", """
  SELECT l_orderkey AS file, (l_partkey * 10)::BIGINT AS start_byte, (l_partkey * 10 + l_quantity)::BIGINT AS end_byte, l_linenumber AS roles,
         CASE WHEN l_linenumber & 1 = 1 THEN 'def' ELSE 'ref' END AS kind FROM lineitem WHERE l_quantity > 0""")
def a3(spark, sf):
    from weftgraph.sources.symbols import split_occurrences

    rows = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), (F.col("l_partkey") * 10).alias("start_byte"), (F.col("l_partkey") * 10 + F.col("l_quantity")).cast("bigint").alias("end_byte"), F.col("l_linenumber").alias("roles"))
    return split_occurrences(rows)


@query("a8_upsert_nodes", """
  SELECT coalesce(n.o_custkey, c.c_custkey) AS id, CASE WHEN n.o_custkey IS NULL THEN c.c_name ELSE n.name END AS name
  FROM customer c FULL JOIN (
    SELECT o_custkey, arg_max('order_' || o_orderkey, o_orderkey) AS name FROM orders WHERE o_orderkey % 3 = 0 GROUP BY o_custkey) n ON n.o_custkey = c.c_custkey""")
def a8(spark, sf):
    old = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    new = table(spark, sf, "orders").where("o_orderkey % 3 = 0").select(F.col("o_custkey").alias("id"), F.concat(F.lit("order_"), "o_orderkey").alias("name"), F.col("o_orderkey").alias("seq"))
    return staging.upsert(old, new, ["id"], "seq")


@query("a9_upsert_chunks", """
  SELECT d.doc_id AS chunk_id, d.source AS relpath, CASE WHEN d.doc_id % 2 = 0 THEN 'kept ' || d.lang ELSE 'new' END AS context_header
  FROM documents d WHERE d.doc_id % 3 <> 0""")
def a9(spark, sf):
    d = table(spark, sf, "documents")
    old = d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("chunk_id"), F.lit("old").alias("relpath"), F.concat(F.lit("kept "), "lang").alias("context_header"))
    new = d.where("doc_id % 3 <> 0").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("relpath"), F.lit("new").alias("context_header"))
    return staging.upsert_chunks(old, new, "chunk_id", ["context_header"])


@query("a12_written_dropped", oracle("""
  SELECT type, (count(*) FILTER (src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k)))::BIGINT AS written,
         (count(*) FILTER (NOT (src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k))))::BIGINT AS dropped
  FROM g_edges GROUP BY type""", "k AS (SELECT id FROM g_nodes WHERE name NOT LIKE '%7%')"))
def a12(spark, sf):
    return staging.written_and_dropped(testgraph.edges(spark, sf), testgraph.nodes(spark, sf).where("name NOT LIKE '%7%'"))


@query("a15_scan_edges", oracle("SELECT src, dst, type, origin_service, confidence FROM g_edges WHERE type IN ('PRODUCES', 'CONSUMES')"))
def a15(spark, sf):
    return testgraph.edges(spark, sf).where(F.col("type").isin("PRODUCES", "CONSUMES")).select("src", "dst", "type", "origin_service", "confidence")


@query("b1_node_props", """
  SELECT p_partkey AS id, p_name || CASE WHEN p_size > 40 THEN '|big' ELSE '|' || p_type END AS shown, CASE WHEN p_size > 40 THEN 2 ELSE 3 END::INT AS n FROM part""")
def b1(spark, sf):
    core = F.create_map(F.lit("name"), F.col("p_name"), F.lit("type"), F.when(F.col("p_size") <= 40, F.col("p_type")), F.lit("brand"), F.when(F.col("p_size") <= 40, F.lit("core")))
    extra = F.create_map(F.lit("brand"), F.when(F.col("p_size") > 40, F.lit("big")).otherwise(F.col("p_type")))
    props = staging.without_nulls(staging.overlay(core, extra))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(props["name"], F.lit("|"), props["brand"]).alias("shown"), F.size(props).alias("n"))


@query("b2_labels", oracle("""
  SELECT id, CASE WHEN kind IN ('Module', 'Class', 'Function') THEN 'Sym,' || kind || CASE WHEN role <> '' THEN ',' || role ELSE '' END ELSE kind END AS labels FROM g_nodes"""))
def b2(spark, sf):
    from weftgraph.operators.load import labels_for_kind

    return testgraph.nodes(spark, sf).select("id", F.array_join(labels_for_kind(F.col("kind"), F.col("roles")), ",").alias("labels"))


@query("b3_edge_props", oracle("""
  SELECT src, dst, type, 'confidence=' || CASE confidence WHEN 1 THEN '1.0' ELSE confidence::VARCHAR END || ';resolution=' || resolution AS props FROM g_edges WHERE type = 'CONTAINS'"""))
def b3(spark, sf):
    made = staging.without_nulls(F.create_map(F.lit("resolution"), F.col("resolution"), F.lit("confidence"), F.col("confidence").cast("string"), F.lit("via"), F.nullif(F.col("via_channel"), F.lit(""))))
    text = F.array_join(F.transform(F.array_sort(F.map_entries(made)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return testgraph.edges(spark, sf).where("type = 'CONTAINS'").select("src", "dst", "type", text.alias("props"))


@query("b4_chunk_props", """
  SELECT d.doc_id AS chunk_id, coalesce(c.c_name, '') AS qualified_name, CASE WHEN c.c_name IS NULL THEN NULL ELSE 'Class' END AS chunk_kind
  FROM documents d LEFT JOIN customer c ON c.c_custkey = d.doc_id * 2""")
def b4(spark, sf):
    owners = table(spark, sf, "customer").select(F.col("c_custkey").alias("owner"), F.col("c_name").alias("qualified_name"), F.lit("Class").alias("chunk_kind"))
    chunks = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), (F.col("doc_id") * 2).alias("owner"))
    return chunks.join(owners, "owner", "left").select("chunk_id", F.coalesce("qualified_name", F.lit("")).alias("qualified_name"), "chunk_kind")


@query("b5_vector_gate", """
  SELECT doc_id AS chunk_id, CASE WHEN e.vec_id IS NOT NULL AND doc_id % 5 <> 0 THEN len(embedding) END::INT AS dim,
         CASE WHEN e.vec_id IS NOT NULL AND doc_id % 5 <> 0 THEN 'm' END AS embed_model FROM documents LEFT JOIN embeddings e ON vec_id = doc_id""")
def b5(spark, sf):
    from weftgraph.operators.load import vector_gate

    e = table(spark, sf, "embeddings")
    d = table(spark, sf, "documents").join(e, F.col("vec_id") == F.col("doc_id"), "left")
    cut = F.when(F.col("doc_id") % 5 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))
    rows = d.select(F.col("doc_id").alias("chunk_id"), cut.alias("embedding"), F.lit("m").alias("embed_model"))
    return vector_gate(rows, 64, True).select("chunk_id", F.when(F.col("embedding").isNotNull(), F.size("embedding")).alias("dim"), "embed_model")


@query("b6_min_confidence", oracle("SELECT src, dst, type FROM g_edges WHERE coalesce(CASE WHEN evidence_line % 7 = 0 THEN NULL ELSE confidence END, 1.0) >= 0.75"))
def b6(spark, sf):
    from weftgraph.operators.graph import above

    e = testgraph.edges(spark, sf).withColumn("confidence", F.when(F.col("evidence_line") % 7 != 0, F.col("confidence")))
    return e.where(above(0.75)).select("src", "dst", "type")


@query("b7_type_filter", oracle("SELECT src, dst, type, resolution FROM g_edges WHERE type IN ('PRODUCES', 'CALLS')"))
def b7(spark, sf):
    from weftgraph.operators.graph import of_types

    return of_types(testgraph.edges(spark, sf), ["PRODUCES", "CALLS"]).select("src", "dst", "type", "resolution")


@query("b8_cross_service", oracle("""
  SELECT s.src, s.dst, s.type FROM (SELECT src, dst, type, split_part(src, ':', 2) AS a, split_part(dst, ':', 2) AS b FROM bad
  WHERE src NOT LIKE 'chan:%' AND dst NOT LIKE 'chan:%') s WHERE a <> b""", """
  bad AS (SELECT src, dst, type FROM g_edges UNION ALL SELECT a.id, b.id, 'CALLS' FROM supp a JOIN cust b ON a.s_suppkey = b.c_custkey)"""))
def b8(spark, sf):
    n = testgraph.nodes(spark, sf).where("kind = 'Class'")
    key = F.substring_index("id", "/", -1)
    a = n.where("id LIKE '%:supplier/%'").select(key.alias("k"), F.col("id").alias("src"))
    b = n.where("id LIKE '%:customer/%'").select(key.alias("k"), F.col("id").alias("dst"))
    bad = a.join(b, "k").select("src", "dst", F.lit("CALLS").alias("type"), F.lit("").alias("via_channel"))
    e = testgraph.edges(spark, sf).select("src", "dst", "type", "via_channel").unionByName(bad)
    return staging.crosses_services(e).select("src", "dst", "type")


@query("b9_selector", """
  SELECT event_id, CASE WHEN event_id % 4 = 3 THEN NULL WHEN event_id % 4 = 0 THEN 'route' ELSE 'qualified' END AS kind,
         CASE WHEN event_id % 4 = 3 THEN NULL ELSE 'user' || user_id END AS service, CASE WHEN event_id % 4 = 0 THEN 'GET' END AS method,
         CASE event_id % 4 WHEN 3 THEN NULL WHEN 0 THEN '/' || event_type WHEN 1 THEN 'app.' || event_type ELSE 'fetch /x' END AS name FROM events""")
def b9(spark, sf):
    svc = F.concat(F.lit("user"), F.col("user_id"))
    text = (F.when(F.col("event_id") % 4 == 0, F.concat(svc, F.lit(":get /"), "event_type")).when(F.col("event_id") % 4 == 1, F.concat(svc, F.lit(":app."), "event_type"))
            .when(F.col("event_id") % 4 == 2, F.concat(svc, F.lit(":fetch /x"))).otherwise(F.lit("no colon")))
    s = scalars.selector(F.col("text"))
    return table(spark, sf, "events").select("event_id", text.alias("text")).select("event_id", s["kind"].alias("kind"), s["service"].alias("service"), s["method"].alias("method"), s["name"].alias("name"))


@query("b10_wildcard", """SELECT p_partkey AS id, p_name AS name FROM part WHERE regexp_matches('pkg.' || replace(p_name, ' ', '.'), '^(.*[.])?blue.*t$')""")
def b10(spark, sf):
    dotted = F.concat(F.lit("pkg."), F.replace("p_name", F.lit(" "), F.lit(".")))
    return table(spark, sf, "part").where(scalars.wildcard(dotted, "blue*t")).select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"))


@query("b11_template_match", """
  WITH hits AS (SELECT page_id, split_part(split_part(url, '://', 2), '/', 1) AS host, regexp_extract(url, '://[^/]*([^?#]*)', 1) AS path FROM pages)
  SELECT page_id, path, len(string_split(path, '/')) = 3 AND split_part(path, '/', 2) = 'en' AS matched FROM hits""")
def b11(spark, sf):
    path = F.regexp_extract("url", "://[^/]*([^?#]*)", 1)
    return table(spark, sf, "pages").select("page_id", path.alias("path"), scalars.template_matches(F.lit("/en/{id}"), path).alias("matched"))


@query("b12_stale", """SELECT doc_id, sha256(text) <> sha256(CASE WHEN doc_id % 3 = 0 THEN left(text, length(text) - 1) ELSE text END) AS stale FROM documents""")
def b12(spark, sf):
    from weftgraph.operators.load import is_stale

    staged = F.sha2(F.when(F.col("doc_id") % 3 == 0, F.substring("text", F.lit(1), F.length("text") - 1)).otherwise(F.col("text")), 256)
    return table(spark, sf, "documents").select("doc_id", is_stale(F.col("text").cast("binary"), F.lit(0), F.octet_length("text"), staged).alias("stale"))


@query("b14_clamp", "SELECT o_orderkey AS id, greatest(1, least(12, o_orderkey % 40 - 5))::BIGINT AS hops, greatest(1, least(20, o_custkey))::BIGINT AS k FROM orders")
def b14(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), scalars.clamp(F.col("o_orderkey") % 40 - 5, 1, 12).cast("bigint").alias("hops"), scalars.clamp(F.col("o_custkey"), 1, 20).cast("bigint").alias("k"))


@query("b15_callable", "SELECT p_partkey AS id, p_size % 2 = 0 AS callable FROM part")
def b15(spark, sf):
    from weftgraph.operators.calls import is_callable

    symbol = F.concat(F.lit("`m`/"), F.col("p_brand"), F.when(F.col("p_size") % 2 == 0, "().").otherwise("#"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), is_callable(symbol).alias("callable"))


@query("b16_channel_containment", oracle("SELECT src, dst FROM g_edges WHERE type = 'CONTAINS' AND src LIKE 'chan:%' AND dst LIKE 'chan:%'"))
def b16(spark, sf):
    from weftgraph.operators.link import channel_containment

    return channel_containment(testgraph.edges(spark, sf)).select("src", "dst")


@query("d2_nodes_by_kind", oracle("SELECT kind, count(*)::BIGINT AS n FROM g_nodes GROUP BY kind"))
def d2_nodes(spark, sf):
    return testgraph.nodes(spark, sf).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


@query("d2_edges_by_type", oracle("SELECT type, count(*)::BIGINT AS n FROM g_edges GROUP BY type"))
def d2_edges(spark, sf):
    return testgraph.edges(spark, sf).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("d3_staging_counts", oracle("SELECT 'nodes' AS name, service, count(*)::BIGINT AS n FROM g_nodes GROUP BY service UNION ALL SELECT 'edges', origin_service, count(*)::BIGINT FROM g_edges GROUP BY origin_service"))
def d3(spark, sf):
    n = testgraph.nodes(spark, sf).groupBy("service").agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("name"), "service", "n")
    e = testgraph.edges(spark, sf).groupBy(F.col("origin_service").alias("service")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("name"), "service", "n")
    return n.unionByName(e)


@query("d4_service_digest", """SELECT user_id AS service, sha256(string_agg(event_type || chr(31) || props, chr(10) ORDER BY (event_type || chr(31) || props))) AS digest FROM events GROUP BY user_id""")
def d4(spark, sf):
    return staging.ordered_digest(table(spark, sf, "events").withColumnRenamed("user_id", "service"), ["service"], [F.col("event_type"), F.col("props")])


@query("d5_refs_hash", """
  SELECT l_orderkey AS relpath, sha256(string_agg('s' || l_partkey || chr(31) || (l_partkey * 3) || chr(31) || (l_partkey * 3 + 2) || chr(31) || l_linenumber, chr(10)
         ORDER BY ('s' || l_partkey || chr(31) || (l_partkey * 3) || chr(31) || (l_partkey * 3 + 2) || chr(31) || l_linenumber))) AS digest FROM lineitem GROUP BY l_orderkey""")
def d5(spark, sf):
    r = table(spark, sf, "lineitem").withColumnRenamed("l_orderkey", "relpath")
    text = lambda c: c.cast("string")
    return staging.ordered_digest(r, ["relpath"], [F.concat(F.lit("s"), "l_partkey"), text(F.col("l_partkey") * 3), text(F.col("l_partkey") * 3 + 2), text(F.col("l_linenumber"))])


@query("d10_report", oracle("""
  SELECT type, (count(*) FILTER (resolution = 'static'))::BIGINT AS n_static, count(*)::BIGINT AS n, round(100.0 * count(*) FILTER (resolution = 'heuristic') / count(*), 6) AS pct_heuristic FROM g_edges GROUP BY type"""))
def d10(spark, sf):
    from weftgraph.operators.report import percent

    a = testgraph.edges(spark, sf).groupBy("type").agg(F.count_if(F.col("resolution") == "static").alias("n_static"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("resolution") == "heuristic").alias("u"))
    return a.select("type", "n_static", "n", F.round(percent(F.col("u"), F.col("n")), 6).alias("pct_heuristic"))


@query("d11_enum_fan_out", """
  SELECT user_id, value, count(*)::BIGINT AS callsite_count FROM (SELECT user_id, unnest(string_split(event_type || ',' || CASE WHEN event_id % 2 = 0 THEN 'even' ELSE event_type END, ',')) AS value FROM events) GROUP BY ALL""")
def d11(spark, sf):
    values = F.array("event_type", F.when(F.col("event_id") % 2 == 0, "even").otherwise(F.col("event_type")))
    return table(spark, sf, "events").select("user_id", F.explode(values).alias("value")).groupBy("user_id", "value").agg(F.count(F.lit(1)).alias("callsite_count"))


@query("e1_dedup_edges", oracle("""
  SELECT src, dst, type, via_channel, origin_service, resolution, confidence, evidence_line FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, type, via_channel
    ORDER BY CASE resolution WHEN 'trace_validated' THEN 3 WHEN 'static' THEN 2 WHEN 'dynamic' THEN 1 WHEN 'heuristic' THEN 0 ELSE -1 END DESC, confidence DESC, origin_service, evidence_file, evidence_line) AS k FROM g_edges) WHERE k = 1"""))
def e1(spark, sf):
    return dedup.dedup_edges(testgraph.edges(spark, sf)).select("src", "dst", "type", "via_channel", "origin_service", "resolution", "confidence", "evidence_line")


@query("e2_disambiguate", """
  SELECT event_id, user_id, CASE WHEN k = 1 THEN event_type ELSE event_type || '~' || k END AS id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events)""")
def e2(spark, sf):
    d = table(spark, sf, "events").withColumn("id", F.col("event_type"))
    return dedup.disambiguate(d, ["user_id"], "id", ["ts", "event_id"]).select("event_id", "user_id", "id")


@query("h1_relpath_to_module", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN source || '.' || lang ELSE source || '.' || lang || '.f' || doc_id END AS module FROM documents")
def h1(spark, sf):
    p = F.concat("source", F.lit("/"), "lang", F.when(F.col("doc_id") % 4 == 0, "/__init__.py").otherwise(F.concat(F.lit("/f"), "doc_id", F.lit(".py"))))
    return table(spark, sf, "documents").select("doc_id", ids.relpath_to_module(p).alias("module"))


@query("h2_containing_package", "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN source || '.' || lang WHEN 1 THEN source ELSE '' END AS package FROM documents")
def h2(spark, sf):
    p = F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit("/"), "lang", F.lit("/__init__.py"))).when(F.col("doc_id") % 3 == 1, F.concat("source", F.lit("/m.py"))).otherwise("top.py")
    return table(spark, sf, "documents").select("doc_id", ids.containing_package(p).alias("package"))


@query("h3_relative_import", """
  SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'x.y' WHEN 1 THEN source || '.' || lang || '.x.y' WHEN 2 THEN source || '.x.y' ELSE 'x.y' END AS target FROM documents""")
def h3(spark, sf):
    package = F.concat("source", F.lit("."), "lang")
    return table(spark, sf, "documents").select("doc_id", ids.resolve_relative_import(package, (F.col("doc_id") % 4).cast("int"), F.lit("x.y")).alias("target"))


@query("h4_descriptors", "SELECT o_orderkey AS id, '`app.' || o_orderstatus || '`/C#' || CASE WHEN o_orderkey % 2 = 0 THEN 'run().' ELSE '' END AS descriptor, 'app.' || o_orderstatus || '.C' || CASE WHEN o_orderkey % 2 = 0 THEN '.run' ELSE '' END AS shown FROM orders")
def h4(spark, sf):
    d = ids.structural_descriptor(F.concat(F.lit("app."), "o_orderstatus"), F.array(F.lit("C")), F.when(F.col("o_orderkey") % 2 == 0, "run"))
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), d.alias("descriptor")).select("*", ids.display_name(F.col("descriptor")).alias("shown"))


SLUG = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim({0})), '\\s+', '-', 'g'), '[^a-z0-9-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g')"


@query("h5_slugify", f"SELECT doc_id, {SLUG.format('text')} AS slug FROM documents")
def h5(spark, sf):
    return table(spark, sf, "documents").select("doc_id", ids.slugify(F.col("text")).alias("slug"))


@query("h6_ids", """
  SELECT event_id, 'sym:user' || user_id || ':`m`/f' || event_id || '().' AS symbol, 'user' || user_id AS service, 'sym:user' || user_id || ':a.py:local' || event_id AS local_id,
         'chan:http:' || CASE WHEN event_id % 2 = 0 THEN '?' ELSE event_type END || ':GET /x' AS route, CASE WHEN event_id % 3 = 0 THEN NULL ELSE '`m`/f' || event_id || '(). tail' END AS descriptor FROM events""")
def h6(spark, sf):
    svc = F.concat(F.lit("user"), "user_id")
    symbol = ids.symbol_id(svc, F.concat(F.lit("`m`/f"), "event_id", F.lit("().")))
    symbol_text = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("local "), "event_id")).otherwise(F.concat(F.lit("index python pkg 1.0 `m`/f"), "event_id", F.lit("(). tail")))
    return table(spark, sf, "events").select(
        "event_id", symbol.alias("symbol"), ids.service_of(symbol).alias("service"), ids.local_symbol_id(svc, F.lit("a.py"), F.concat(F.lit("local "), "event_id")).alias("local_id"),
        ids.route_id(F.when(F.col("event_id") % 2 == 1, F.col("event_type")), F.lit("GET"), F.lit("/x")).alias("route"), F.get(ids.symbol_parts(symbol_text), F.lit(4)).alias("descriptor"))


@query("h7_line_index", "SELECT doc_id, len(string_split(text, chr(10)))::INT AS n, list_sum(list_transform(string_split(text, chr(10)), lambda x: strlen(x)))::BIGINT AS bytes FROM documents")
def h7(spark, sf):
    starts = scalars.line_starts(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.size(starts).alias("n"), (F.octet_length("text") - F.size(starts) + 1).cast("bigint").alias("bytes"))


@query("h8_line_at", "SELECT doc_id, (1 + strlen(substr(text, 1, length(text) // 2)) - strlen(replace(substr(text, 1, length(text) // 2), chr(10), '')))::INT AS line FROM documents")
def h8(spark, sf):
    at = F.octet_length(F.substring("text", F.lit(1), F.floor(F.length("text") / 2).cast("int")))
    return table(spark, sf, "documents").select("doc_id", scalars.line_at(scalars.line_starts(F.col("text")), at).alias("line"))


@query("h9_hostname", "SELECT page_id, lower(regexp_extract(url, '://([^/?#:]+)', 1)) AS host, split_part(lower(regexp_extract(url, '://([^/?#:]+)', 1)), '.', 1) AS label FROM pages")
def h9(spark, sf):
    return table(spark, sf, "pages").select("page_id", scalars.hostname(F.col("url")).alias("host")).select("*", scalars.first_label(F.col("host")).alias("label"))


@query("h10_join_template", "SELECT p_partkey AS id, CASE WHEN p_size % 3 = 0 THEN (CASE WHEN p_size % 2 = 0 THEN '/' ELSE '/api' END) ELSE (CASE WHEN p_size % 2 = 0 THEN '' ELSE '/api' END) || '/' || p_type END AS template FROM part")
def h10(spark, sf):
    prefix = F.when(F.col("p_size") % 2 == 0, "").otherwise("/api")
    path = F.when(F.col("p_size") % 3 == 0, "").otherwise(F.concat(F.lit("/"), "p_type"))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), scalars.join_template(prefix, path).alias("template"))


@query("h11_sanitize", """SELECT doc_id, trim(regexp_replace(translate(text, '@{}()|-=~*:"''%[]', '                '), '\\s+', ' ', 'g')) AS q FROM documents""")
def h11(spark, sf):
    return table(spark, sf, "documents").select("doc_id", scalars.sanitize_query(F.col("text")).alias("q"))


@query("h12_or_rewrite", "SELECT p_partkey AS id, CASE WHEN p_size % 2 = 0 THEN replace(p_name, ' ', ' | ') END AS q FROM part")
def h12(spark, sf):
    q = F.when(F.col("p_size") % 2 == 0, F.col("p_name")).otherwise(F.substring_index("p_name", " ", 1))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), scalars.or_rewrite(q).alias("q"))


@query("h13_snippet", "SELECT doc_id, substr(text, 1, 600) AS snippet FROM documents")
def h13(spark, sf):
    return table(spark, sf, "documents").select("doc_id", scalars.snippet(F.col("text")).alias("snippet"))


DISTANCE = "round(1 - list_sum(list_transform(list_zip({0}, {1}), lambda p: p[1]::DOUBLE * p[2]::DOUBLE)) / (sqrt(list_sum(list_transform({0}, lambda x: x::DOUBLE * x::DOUBLE))) * sqrt(list_sum(list_transform({1}, lambda x: x::DOUBLE * x::DOUBLE)))), 6)"


@query("h14_cosine", f"SELECT a.vec_id, {DISTANCE.format('a.embedding', 'b.embedding')} AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def h14(spark, sf):
    e = table(spark, sf, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(b, "vec_id").select("vec_id", F.round(scalars.cosine_distance(F.col("embedding"), F.col("other")), 6).alias("distance"))


@query("h16_input_hash", "SELECT doc_id, sha256(source || chr(10) || chr(10) || text) AS input_hash FROM documents")
def h16(spark, sf):
    return table(spark, sf, "documents").select("doc_id", scalars.input_hash(F.col("source"), F.col("text")).alias("input_hash"))


@query("h18_json_access", """SELECT event_id, (props->>'k')::INT AS k, 'user' || user_id AS _service, event_type || '.py' AS _relpath FROM events""")
def h18(spark, sf):
    from weftgraph.sources.claims import parsed

    c = table(spark, sf, "events").select("event_id", F.concat(F.lit("user"), "user_id").alias("service"), F.concat("event_type", F.lit(".py")).alias("relpath"), F.col("props").alias("payload"))
    return parsed(c, "k int").select("event_id", "k", "_service", "_relpath")


@query("h19_confidence", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 0.8 ELSE least(0.8, 0.6) END::DOUBLE AS confidence FROM events")
def h19(spark, sf):
    return table(spark, sf, "events").select("event_id", scalars.combine_confidence(F.col("event_id") % 2 == 0, F.lit(0.8)).alias("confidence"))


@query("h20_channel_name", "SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '${TOPIC_' || user_id || '}' END AS name FROM events")
def h20(spark, sf):
    return table(spark, sf, "events").select("event_id", scalars.channel_name(F.when(F.col("event_id") % 2 == 0, F.col("event_type")), F.concat(F.lit("TOPIC_"), "user_id")).alias("name"))


@query("h21_config_ref", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'A' || user_id WHEN 1 THEN 'B' WHEN 2 THEN event_type END AS ref FROM events""")
def h21(spark, sf):
    m = F.col("event_id") % 4
    text = F.when(m == 0, F.concat(F.lit('settings.z + os.environ["A'), "user_id", F.lit('"]'))).when(m == 1, F.lit("os.getenv('B', 1)")).when(m == 2, F.concat(F.lit("settings."), "event_type")).otherwise("other")
    return table(spark, sf, "events").select("event_id", scalars.config_ref(text).alias("ref"))


@query("h23_path_claim", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN '/a/' || page_id WHEN 1 THEN '/b' ELSE '/lit' END AS path, CASE page_id % 3 WHEN 1 THEN 'heuristic' ELSE 'static' END AS hint FROM pages""")
def h23(spark, sf):
    m = F.col("page_id") % 3
    c = scalars.path_claim(F.when(m == 0, F.concat(F.lit("<base>/a/"), "page_id")).when(m == 1, F.lit("/b")), F.when(m == 2, F.lit("/lit")))
    return table(spark, sf, "pages").select("page_id", c["path"].alias("path"), c["hint"].alias("hint"))


@query("h24_one_line", r"""SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS line, substr(split_part(text, chr(10), 1), 1, 120) AS first FROM documents""")
def h24(spark, sf):
    d = table(spark, sf, "documents")
    return d.select("doc_id", scalars.one_line(F.col("text")).alias("line"), scalars.first_line(F.col("text"), 120).alias("first"))


@query("h26_decorator", """SELECT p_partkey AS id, p_size % 4 IN (0, 1) AS matched FROM part""")
def h26(spark, sf):
    m = F.col("p_size") % 4
    text = F.when(m == 0, "app.get").when(m == 1, F.concat(F.lit("app.get('/"), "p_type", F.lit("')"))).when(m == 2, "app.getter").otherwise("app.post('/')")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), scalars.decorator_matches(text, "app.get").alias("matched"))


@query("h27_path_suffix", """SELECT p_partkey AS id, p_size % 3 <> 2 AS matched FROM part""")
def h27(spark, sf):
    m = F.col("p_size") % 3
    path = F.when(m == 0, F.array(F.lit("self"), F.lit("client"), F.lit("get"))).when(m == 1, F.array(F.lit("session"), F.lit("request"))).otherwise(F.array(F.lit("get")))
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), scalars.path_suffix_matches(path, "client.get|session.request").alias("matched"))
