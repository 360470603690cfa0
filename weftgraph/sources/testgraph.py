"""A property graph derived from the driver's tables; the same SQL text runs in Spark and in DuckDB."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.session import table

PARTS = """
place AS (SELECT n_nationkey, n_name, r_name FROM {nation} JOIN {region} ON n_regionkey = r_regionkey),
cust AS (SELECT c_custkey, c_name, r_name AS service, n_nationkey, 'sym:' || r_name || ':customer/' || c_custkey AS id FROM {customer} JOIN place ON c_nationkey = n_nationkey),
supp AS (SELECT s_suppkey, s_name, r_name AS service, n_nationkey, 'sym:' || r_name || ':supplier/' || s_suppkey AS id FROM {supplier} JOIN place ON s_nationkey = n_nationkey),
ord AS (
  SELECT o_orderkey, service, cust.id AS parent, 'sym:' || service || ':order/' || o_orderkey AS id,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'RouteHandler' WHEN '2-HIGH' THEN 'MessageConsumer' WHEN '3-MEDIUM' THEN 'TemporalActivity'
              WHEN '4-NOT SPECIFIED' THEN 'TemporalWorkflow' ELSE '' END AS role
  FROM {orders} JOIN cust ON o_custkey = c_custkey),
ev AS (
  SELECT event_id, user_id, ts, event_type, 'sym:user' || user_id || ':event/' || event_id AS id,
         lead('sym:user' || user_id || ':event/' || event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next_id
  FROM {events}),
line AS (
  SELECT l_orderkey, l_suppkey, l_partkey, l_linenumber, l_quantity, l_discount,
         CASE l_returnflag WHEN 'R' THEN 'static' ELSE 'heuristic' END AS resolution,
         CASE l_returnflag WHEN 'R' THEN 1.0e0 WHEN 'A' THEN 0.8e0 ELSE 0.6e0 END AS confidence
  FROM {lineitem}),
"""
NODES = """
g_nodes AS (
  SELECT 'svc:' || r_name AS id, 'Service' AS kind, r_name AS service, r_name AS name, '' AS role FROM {region}
  UNION ALL SELECT 'sym:' || r_name || ':nation/' || n_nationkey, 'Module', r_name, n_name, '' FROM place
  UNION ALL SELECT id, 'Class', service, c_name, '' FROM cust
  UNION ALL SELECT id, 'Class', service, s_name, '' FROM supp
  UNION ALL SELECT id, 'Function', service, 'order_' || o_orderkey, role FROM ord
  UNION ALL SELECT id, 'Function', 'user' || user_id, event_type, CASE event_type WHEN 'purchase' THEN 'MessageProducer' ELSE '' END FROM ev
  UNION ALL SELECT 'chan:event_type:' || p_partkey, 'Channel', '', p_name, '' FROM {part}
  UNION ALL SELECT DISTINCT 'chan:kafka_topic:' || p_brand, 'Channel', '', p_brand, '' FROM {part}
)"""
EDGES = """
g_edges AS (
  SELECT 'svc:' || r_name AS src, 'sym:' || r_name || ':nation/' || n_nationkey AS dst, 'CONTAINS' AS type, '' AS via_channel, r_name AS origin_service,
         'static' AS resolution, 1.0e0 AS confidence, n_name AS evidence_file, CAST(n_nationkey AS INT) AS evidence_line FROM place
  UNION ALL SELECT 'sym:' || service || ':nation/' || n_nationkey, id, 'CONTAINS', '', service, 'static', 1.0e0, c_name, 0 FROM cust
  UNION ALL SELECT 'sym:' || service || ':nation/' || n_nationkey, id, 'CONTAINS', '', service, 'static', 1.0e0, s_name, 0 FROM supp
  UNION ALL SELECT parent, id, 'CONTAINS', '', service, 'static', 1.0e0, 'orders', 0 FROM ord
  UNION ALL SELECT 'chan:kafka_topic:' || p_brand, 'chan:event_type:' || p_partkey, 'CONTAINS', '', '', 'heuristic', 0.7e0, 'part', 0 FROM {part}
  UNION ALL SELECT supp.id, 'chan:event_type:' || l_partkey, 'PRODUCES', '', service, resolution, confidence, 'lineitem', CAST(l_linenumber AS INT)
    FROM line JOIN supp ON l_suppkey = s_suppkey WHERE l_quantity >= 45
  UNION ALL SELECT ord.id, 'chan:event_type:' || l_partkey, 'CONSUMES', '', service, resolution, confidence, 'lineitem', CAST(l_linenumber AS INT)
    FROM line JOIN ord ON l_orderkey = o_orderkey WHERE l_discount >= 0.09
  UNION ALL SELECT ord.id, 'chan:kafka_topic:' || p_brand, 'CONSUMES', '', service, 'static', 1.0e0, 'orders', CAST(l_linenumber AS INT)
    FROM line JOIN ord ON l_orderkey = o_orderkey JOIN {part} ON l_partkey = p_partkey WHERE o_orderkey % 100 = 0 AND l_linenumber = 1
  UNION ALL SELECT id, next_id, 'CALLS', '', 'user' || user_id, CASE WHEN event_id % 5 = 0 THEN 'dynamic' ELSE 'static' END,
    CASE WHEN event_id % 5 = 0 THEN 0.9e0 ELSE 1.0e0 END, event_type, CAST(event_id % 1000 AS INT) FROM ev WHERE next_id IS NOT NULL
)"""
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def oracle(body: str, *extra: str) -> str:
    """``body`` over ``g_nodes`` and ``g_edges`` in DuckDB."""
    ctes = ", ".join([(PARTS + NODES + "," + EDGES).strip(), *(x.strip() for x in extra)])
    return re.sub(r"\{(\w+)\}", r"\1", f"WITH RECURSIVE {ctes} {body}")


def _made(spark: SparkSession, sf_dir: str, ctes: str, name: str) -> DataFrame:
    used = sorted(set(re.findall(r"\{(\w+)\}", ctes)))
    return spark.sql(f"WITH {ctes.strip()} SELECT * FROM {name}", **{t: table(spark, sf_dir, t) for t in used})


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, kind, service, name, roles."""
    out = _made(spark, sf_dir, PARTS + NODES, "g_nodes")
    return out.select("id", "kind", "service", "name", F.filter(F.array("role"), lambda r: r != "").alias("roles"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges with duplicates, as several assertions of one fact may give them."""
    return _made(spark, sf_dir, PARTS + EDGES, "g_edges")
