"""From source trees to a linked graph: scan, parse, extract, link."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import ids
from weftgraph.functions.scalars import join_template
from weftgraph.operators import chunks, extract, link, staging
from weftgraph.operators.dedup import dedup_edges, first_rows
from weftgraph.operators.graph import climb
from weftgraph.schema import ENTRY_ROLES
from weftgraph.session import cut
from weftgraph.sources.files import scan_service
from weftgraph.sources.pyfacts import facts, parse
from weftgraph.sources.symbols import index_files, placed, read_indexes, split_occurrences


@dataclass
class Graph:
    """nodes: id, kind, service, relpath, name, qualified_name, spans, roles; edges: as ``extract.edge_rows`` gives them."""

    files: DataFrame
    nodes: DataFrame
    edges: DataFrame
    processes: DataFrame
    members: DataFrame
    chunks: DataFrame | None = None


def scan(spark: SparkSession, services: dict[str, str], excludes: tuple[str, ...] | dict[str, tuple[str, ...]] = ()) -> DataFrame:
    """The files of all services; ``excludes`` are patterns for all of them, or by service."""
    out = None
    for name, root in sorted(services.items()):
        one = scan_service(spark, root, name, excludes.get(name, ()) if isinstance(excludes, dict) else excludes)
        out = one if out is None else out.unionByName(one)
    return out


def extract_all(files: DataFrame, idioms: extract.Idioms, parsed: DataFrame | None = None, refs: DataFrame | None = None) -> dict[str, DataFrame]:
    """Nodes, edges and claims of all files, before any linking; ``parsed`` if the facts are there already, ``refs`` of the services that have a symbol index."""
    parsed = cut(parse(files)) if parsed is None else parsed
    modules = cut(extract.module_table(files))
    defs = cut(extract.definitions(parsed, modules))
    nodes, edges = extract.core(files, defs, facts(parsed, "import"), modules)
    sites = cut(extract.resolved_calls(parsed, defs, modules, refs))
    found = [edges, extract.call_graph(sites, defs), extract.singleton_calls(sites, extract.singletons(parsed, modules), defs)]
    attributes = extract.class_attributes(parsed, defs)
    found.append(extract.producers(parsed, sites, idioms.producers, attributes))
    found.append(extract.consumers(parsed, sites, defs, modules, idioms.consumers, attributes))
    t = extract.temporal(parsed, sites, defs, modules)
    found.append(t["edges"])
    routes, mounts = extract.routes(parsed, defs)
    found.append(extract.dependencies(sites, routes, parsed, defs, modules))
    found += [extract.enum_producers(sites, attributes, rule) for rule in idioms.producers]
    every = found[0]
    for e in found[1:]:
        every = every.unionByName(e)
    roles = t["roles"].unionByName(routes.select(F.col("handler").alias("id"), F.lit("RouteHandler").alias("role")))
    roles = roles.unionByName(every.where("type = 'PRODUCES'").select(F.col("src").alias("id"), F.lit("MessageProducer").alias("role")))
    roles = roles.unionByName(every.where("type = 'CONSUMES' AND dst NOT LIKE 'chan:temporal_signal:%'").select(F.col("src").alias("id"), F.lit("MessageConsumer").alias("role")))
    patches = roles.groupBy("id").agg(F.array_sort(F.collect_set("role")).alias("add_roles")).join(extract.role_props(t["roles"], routes, defs), "id", "left")
    patched = staging.patch_nodes(nodes.withColumn("props", F.lit(None).cast("map<string,string>")), patches)
    return {"nodes": patched, "edges": cut(every), "routes": routes, "mounts": mounts, "http": extract.http_calls(parsed, sites, defs, idioms.clients).join(extract.base_url_envs(parsed, defs, attributes), ["service", "relpath", "cls"], "left"), "modules": modules, "starts": t["starts"], "sends": t["sends"], "defs": defs, "parsed": parsed}


def route_channels(routes: DataFrame, mounts: DataFrame) -> DataFrame:
    """service, method, template, handler: each handler under every prefix of its router (its own if the prefixes overflow)."""
    key = lambda service, name: F.concat(service, F.lit("/"), name)
    names = routes.select("service", "router", "own", "is_root").distinct()
    m = mounts.select(key(F.col("service"), F.col("parent")).alias("parent"), key(F.col("service"), F.regexp_replace("child", r"^.*\.", "")).alias("child"), "prefix")
    own = routes.select(key(F.col("service"), F.col("router")).alias("child"), "own").distinct()
    m = m.join(own, "child", "left").select("parent", "child", F.concat("prefix", F.coalesce("own", F.lit(""))).alias("prefix"))
    roots = names.where("is_root").select(key(F.col("service"), F.col("router")).alias("router"))
    roots = roots.unionByName(m.join(m.select(F.col("child").alias("parent")).distinct(), "parent", "left_anti").select(F.col("parent").alias("router"))).distinct()
    prefixes = link.router_prefixes(m, roots)
    r = routes.withColumn("__key", key(F.col("service"), F.col("router"))).join(prefixes.select(F.col("router").alias("__key"), F.col("prefix").alias("mounted")), "__key", "left")
    return r.select("service", "relpath", "line", "method", join_template(F.coalesce("mounted", "own"), F.col("path")).alias("template"), "handler").distinct()


def env_tables(spark: SparkSession, envs: tuple[dict, dict, dict]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The maps from environment names to declared services, to services by host name, and to hosts, as tables of what the configuration holds."""
    of = lambda pairs, name: spark.createDataFrame(sorted(pairs.items()), f"env string, {name} string")
    return of(envs[0], "service"), of(envs[1], "service"), of(envs[2], "host")


def link_all(found: dict[str, DataFrame], envs: tuple[dict, dict, dict] = ({}, {}, {}), declared: DataFrame | None = None) -> dict[str, DataFrame]:
    """All cross-service edges, channel nodes and processes; the order of passes matters. ``envs`` as ``config.env_maps`` gives them."""
    edges = found["edges"]
    marked = link.apply_start_marks(edges, found["starts"].select("src", "dst"))
    started = marked.where("mechanism IS NOT NULL").select("src", "dst", F.col("confidence").alias("c"), F.col("resolution").alias("r"))
    lines = found["starts"].groupBy("src", "dst").agg(F.min("line").alias("line"))
    extra = started.join(edges.where("type = 'CALLS'").select("src", "dst"), ["src", "dst"], "left_anti").join(lines, ["src", "dst"])
    extra = extra.select("src", "dst", ids.service_of(F.col("src")).alias("service"), F.lit("").alias("relpath"), "line", "c", "r")
    edges = edges.unionByName(extract.edge_rows(extra, "CALLS", F.col("r"), F.col("c"), extractor="linking"))
    sent = link.link_signals(found["sends"], edges).select("src", "dst", ids.service_of(F.col("src")).alias("service"), F.lit("").alias("relpath"), F.lit(0).alias("line"))
    edges = edges.unionByName(extract.edge_rows(sent, "PRODUCES", extractor="linking"))
    routed = cut(route_channels(found["routes"], found["mounts"]))
    handles = routed.select(ids.route_id(F.col("service"), F.col("method"), F.col("template")).alias("src"), F.col("handler").alias("dst"), "service", "relpath", "line")
    edges = edges.unionByName(extract.edge_rows(handles, "HANDLES", extractor="linking"))
    claims = found["http"].select(F.concat_ws("|", "src", "method", "path", "line").alias("claim_id"), "src", "method", "path", "env", "service", "relpath", "line").dropDuplicates(["claim_id"])
    claims = cut(link.target_tier(claims, *env_tables(edges.sparkSession, envs)))
    linked = link.link_routes(claims.where("tier IN ('anchored', 'unanchored')").select("claim_id", "method", "path", "allowed"), routed.select(F.col("service").alias("owner"), "method", "template"))
    lost = claims.where("tier IN ('external', 'unmapped')").select("claim_id", F.lit("?").alias("owner"), F.col("path").alias("template"), "tier", F.lit("heuristic").alias("resolution"), F.lit(0.5).alias("confidence"))
    sent = claims.drop("tier").join(linked.unionByName(lost), "claim_id").select("src", ids.route_id(F.col("owner"), F.col("method"), F.col("template")).alias("dst"), "service", "relpath", "line", "resolution", "confidence", "external_host")
    edges = cut(edges.unionByName(extract.edge_rows(sent, "CALLS_HTTP", F.col("resolution"), F.col("confidence"), extractor="linking", external=F.col("external_host"))))
    hand = link.next_segments(edges).select("src", "dst", "via_channel", "resolution", "confidence", ids.service_of(F.col("src")).alias("service"), F.lit("").alias("relpath"), F.lit(0).alias("line"))
    edges = edges.unionByName(extract.edge_rows(hand, "NEXT_SEGMENT", F.col("resolution"), F.col("confidence"), F.col("via_channel"), extractor="linking"))
    ends = edges.select(F.col("src").alias("id")).unionByName(edges.select(F.col("dst").alias("id"))).where("id LIKE 'chan:%'").distinct()
    none = F.array().cast("array<string>")
    name = F.when(F.col("id").rlike("^chan:http:"), F.regexp_replace("id", "^chan:http:[^:]*:", "")).otherwise(F.regexp_replace("id", "^chan:[^:]*:", ""))
    channels = ends.select("id", F.lit("Channel").alias("kind"), F.lit("").alias("service"), F.lit("").alias("relpath"), name.alias("name"), name.alias("qualified_name"), F.lit(0).cast("bigint").alias("start_byte"), F.lit(0).cast("bigint").alias("end_byte"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), none.alias("roles"), F.lit(None).cast("map<string,string>").alias("props"))
    nodes = found["nodes"].unionByName(channels)
    flows = nodes.where("array_contains(roles, 'TemporalWorkflow')").select(ids.process_id(F.concat_ws(" ", "service", "name")).alias("process"), F.concat_ws(" ", "service", "name").alias("name"), F.col("id").alias("entry"), F.lit("temporal").alias("source"))
    if declared is not None:
        flows = declared.select(ids.process_id(F.col("name")).alias("process"), "name", "entry", F.lit("config").alias("source")).unionByName(flows)
    flows = first_rows(flows, ["process"], [F.col("source"), F.col("entry")], ["name", "entry", "source"])
    members = link.part_of_process(entry_graph(edges, nodes), flows.select("process", "entry"))
    return {"nodes": cut(nodes), "edges": cut(dedup_edges(edges)), "processes": flows, "members": members}


def chunk_table(files: DataFrame, found: dict[str, DataFrame], nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The chunks of all files with their headers and input hashes."""
    made = chunks.chunk_files(files, found["defs"], found["modules"])
    parents = edges.where("type = 'CONTAINS'").select(F.col("dst").alias("id"), F.col("src").alias("up")).join(nodes.where("kind = 'Class'").select(F.col("id").alias("up"), F.col("name").alias("parent")), "up").groupBy("id").agg(F.min("parent").alias("parent"))
    docs = found["defs"].select("id", "doc").unionByName(facts(found["parsed"], "const").where("name = '__doc__'").join(found["modules"], ["service", "relpath"]).select(F.col("module_id").alias("id"), F.col("value").alias("doc"))).groupBy("id").agg(F.min("doc").alias("doc"))
    symbols = nodes.join(parents, "id", "left").join(docs, "id", "left").select(F.col("id").alias("symbol_id"), "qualified_name", F.col("kind").alias("node_kind"), "roles", "parent", "doc").withColumnRenamed("node_kind", "kind")
    imported = facts(found["parsed"], "import").select("service", "relpath", F.concat_ws(".", "module", F.when(F.col("name") != "", F.col("name"))).alias("name"))
    called = edges.where("type = 'CALLS'").join(nodes.select(F.col("id").alias("dst"), "name"), "dst").select(F.col("src").alias("symbol_id"), "name")
    return chunks.headers(made.withColumnRenamed("kind", "chunk_kind"), symbols, imported, called)


def entry_graph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Hand-offs re-keyed by the entry that their producer belongs to."""
    hand = edges.where("type = 'NEXT_SEGMENT'").select("src", "dst", "resolution", "confidence").distinct()
    intra = edges.where("type IN ('CALLS', 'DEPENDS_ON', 'INVOKES_ACTIVITY')")
    entries = nodes.where(F.arrays_overlap("roles", F.array(*map(F.lit, ENTRY_ROLES)))).select("id")
    owner = climb(intra, hand.select(F.col("src").alias("id")).distinct(), entries).withColumnsRenamed({"start": "src", "top": "entry"})
    return hand.join(owner, "src").select(F.col("entry").alias("src"), "dst", "resolution", "confidence").distinct()


def references(files: DataFrame, indexes: dict[str, str]) -> DataFrame | None:
    """References of the services whose binary index is given by path, in bytes of ``files``; none if there is no index."""
    if not indexes:
        return None
    return cut(split_occurrences(placed(read_indexes(index_files(files.sparkSession, indexes)), files)).where("kind = 'ref'"))


def index(spark: SparkSession, services: dict[str, str], idioms: extract.Idioms | None = None, envs: tuple[dict, dict, dict] = ({}, {}, {}), declared: DataFrame | None = None, indexes: dict[str, str] | None = None, excludes: tuple[str, ...] | dict[str, tuple[str, ...]] = ()) -> Graph:
    """The whole pipeline. ``services`` maps a name to a path that Spark can read, ``indexes`` a service to its symbol index."""
    files = cut(scan(spark, services, excludes))
    return build(files, None, idioms, envs, declared, references(files, indexes or {}))


def build(files: DataFrame, parsed: DataFrame | None = None, idioms: extract.Idioms | None = None, envs: tuple[dict, dict, dict] = ({}, {}, {}), declared: DataFrame | None = None, refs: DataFrame | None = None) -> Graph:
    found = extract_all(files, idioms or extract.Idioms(), parsed, refs)
    linked = link_all(found, envs, declared)
    return Graph(files, linked["nodes"], linked["edges"], linked["processes"], linked["members"], chunk_table(files, found, linked["nodes"], linked["edges"]))
