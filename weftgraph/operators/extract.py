"""From facts to nodes, edges and claims, by joins.

Idioms are data: rules name call paths, decorators or base classes, and say where a channel's name
stands. Positions are resolved to symbols by joins after parsing. Without a resolver's index,
references are the fallback ones (same-file and imported top-level names) and capped at 0.6.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.functions import ids
from weftgraph.functions.scalars import combine_confidence, config_ref, path_suffix_matches, wildcard
from weftgraph.operators import calls as call_ops
from weftgraph.operators.dedup import disambiguate
from weftgraph.sources.pyfacts import facts

FILE = ["service", "relpath"]
FALLBACK_CONFIDENCE = 0.6
#: Names that idioms of frameworks go by.
VERBS = ("get", "post", "put", "patch", "delete", "head", "options")
ROUTERS = ("APIRouter", "FastAPI")
ACTIVITY_CALLS = ("execute_activity", "start_activity", "execute_activity_method", "start_activity_method", "execute_local_activity", "start_local_activity")
START_CALLS = ("start_workflow", "execute_workflow", "start_child_workflow", "execute_child_workflow")


@dataclass(frozen=True)
class Topic:
    """Where the topic that carries an event is named: one of a constant, an argument, a keyword, an environment name, a settings field ``Class.field`` or, as a label only, an attribute."""

    const: str | None = None
    arg: int | None = None
    kwarg: str | None = None
    env: str | None = None
    settings: str | None = None
    attr: str | None = None


@dataclass(frozen=True)
class Producer:
    """A call that produces: ``call`` is a path suffix (alternatives by bars); the channel's name is an argument. An event's ``topic`` contains it."""

    call: str
    kind: str = "event_type"
    position: int = 0
    keyword: str | None = None
    topic: Topic | None = None


@dataclass(frozen=True)
class Consumer:
    """``call``: a subscribing call; ``dispatch_dict``: a dict of name to handler, argument of a call; ``base_class``: a class whose generic argument is the event."""

    form: str
    name: str
    kind: str = "event_type"
    position: int = 0
    keyword: str | None = None
    handler: str = "handle"
    topic: Topic | None = None


@dataclass(frozen=True)
class RouteFrom:
    """A decorator's argument holds the path."""

    decorator: str
    arg: int = 0


@dataclass(frozen=True)
class VerbFrom:
    """The first argument of a request's constructor (alternatives by bars) is ``enum.VERB``."""

    request_ctor: str
    enum: str


@dataclass(frozen=True)
class HttpClient:
    """Calls by verb name; or, with the last three, methods whose path, sending call and verb stand in three places."""

    file_glob: str = "*_client.py"
    class_glob: str = "*Client"
    call: str | None = None
    route_from: RouteFrom | None = None
    verb_from: VerbFrom | None = None


@dataclass(frozen=True)
class Idioms:
    producers: tuple[Producer, ...] = (Producer("producer.send", "kafka_topic", 0, "topic"), Producer("outbox.add|events.publish", "event_type", 0, "event_type"))
    consumers: tuple[Consumer, ...] = (Consumer("call", "KafkaConsumer|AIOKafkaConsumer", "kafka_topic"), Consumer("dispatch_dict", "dispatch|Dispatcher", "event_type", 0, "handlers"), Consumer("base_class", "EventConsumer", "event_type", handler="process_event"))
    clients: tuple[HttpClient, ...] = field(default_factory=lambda: (HttpClient(),))


def module_table(files: DataFrame) -> DataFrame:
    m = ids.relpath_to_module(F.col("relpath"))
    return files.select(*FILE, m.alias("module")).withColumn("module_id", ids.symbol_id(F.col("service"), ids.module_descriptor(F.col("module"))))


def definitions(parsed: DataFrame, modules: DataFrame) -> DataFrame:
    """Definitions with their ids; the n-th of one id in a file gets ``~n``."""
    d = facts(parsed, "def").join(modules, FILE)
    d = d.withColumn("id", ids.symbol_id(F.col("service"), F.concat(ids.module_descriptor(F.col("module")), "descriptor")))
    return disambiguate(d, FILE, "id", ["idx"])


def core(files: DataFrame, defs: DataFrame, imports: DataFrame, modules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): modules, classes and functions; CONTAINS and IMPORTS."""
    none = F.array().cast("array<string>")
    svc = modules.select("service").distinct()
    n = svc.select(F.concat(F.lit("svc:"), "service").alias("id"), F.lit("Service").alias("kind"), "service", F.lit("").alias("relpath"), F.col("service").alias("name"), F.col("service").alias("qualified_name"), F.lit(0).cast("bigint").alias("start_byte"), F.lit(0).cast("bigint").alias("end_byte"), F.lit(0).alias("start_line"), F.lit(0).alias("end_line"), none.alias("roles"))
    size = files.select(*FILE, "size")
    n = n.unionByName(modules.join(size, FILE).select(F.col("module_id").alias("id"), F.lit("Module").alias("kind"), "service", "relpath", F.substring_index("module", ".", -1).alias("name"), F.col("module").alias("qualified_name"), F.lit(0).cast("bigint").alias("start_byte"), F.col("size").alias("end_byte"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"), none.alias("roles")))
    n = n.unionByName(defs.select("id", "kind", "service", "relpath", "name", F.concat_ws(".", "module", "qualname").alias("qualified_name"), "start_byte", "end_byte", "start_line", "end_line", none.alias("roles")))
    up = defs.select(*FILE, F.col("idx").alias("parent"), F.col("id").alias("parent_id"))
    inside = defs.join(up, [*FILE, "parent"], "left").select(F.coalesce("parent_id", "module_id").alias("src"), F.col("id").alias("dst"), "service", "relpath", F.col("start_line").alias("line"))
    top = modules.select(F.concat(F.lit("svc:"), "service").alias("src"), F.col("module_id").alias("dst"), "service", "relpath", F.lit(1).alias("line"))
    e = edge_rows(inside.unionByName(top), "CONTAINS")
    base = ids.resolve_relative_import(ids.containing_package(F.col("relpath")), F.col("level"), F.col("module"))
    i = imports.select(*FILE, base.alias("target"), "name", "pos")
    known = modules.select("service", "module").distinct()
    resolved = call_ops.resolve_imports(i, known).where("module IS NOT NULL").withColumnRenamed("module", "to_module")
    there = modules.select("service", F.col("module").alias("to_module"), F.col("module_id").alias("dst"))
    here = modules.select(*FILE, F.col("module_id").alias("src"))
    met = resolved.join(there, ["service", "to_module"]).join(here, FILE).where("src != dst").select("src", "dst", "service", "relpath", F.lit(1).alias("line")).distinct()
    return n, e.unionByName(edge_rows(met, "IMPORTS"))


def edge_rows(rows: DataFrame, type_: str, resolution: str | Column = "static", confidence: float | Column = 1.0, via: Column | None = None, extractor: str = "python_core", external: Column | None = None) -> DataFrame:
    """Edges in the graph's layout; ``external`` is the host that a call leaves the workspace for."""
    host = external if external is not None else F.lit(None).cast("string")
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    return rows.select("src", "dst", F.lit(type_).alias("type"), (via if via is not None else F.lit("")).alias("via_channel"), F.col("service").alias("origin_service"), lit(resolution).alias("resolution"), lit(confidence).cast("double").alias("confidence"), F.lit(extractor).alias("extractor"), F.col("relpath").alias("evidence_file"), F.col("line").cast("int").alias("evidence_line"), host.isNotNull().alias("external"), host.alias("external_host"))


def resolved_calls(parsed: DataFrame, defs: DataFrame, modules: DataFrame, refs: DataFrame | None = None) -> DataFrame:
    """Call sites with ``src`` (the caller's id), ``symbol`` (the id of what they call, if it can be told), ``resolution`` and ``confidence``.

    Services that ``refs`` (service, relpath, symbol, start_byte, end_byte) speaks of are resolved by it alone, all others by the fallback.
    """
    c = facts(parsed, "call")
    encl = defs.select(*FILE, F.col("idx").alias("encl"), F.col("id").alias("encl_id"), F.col("name").alias("encl_name"))
    c = c.join(modules.select(*FILE, "module_id"), FILE).join(encl, [*FILE, "encl"], "left").withColumn("src", F.coalesce("encl_id", "module_id"))
    top = defs.where("parent IS NULL").groupBy(*FILE, "name").agg(F.min("id").alias("symbol"))
    i = facts(parsed, "import").where("name != ''")
    base = ids.resolve_relative_import(ids.containing_package(F.col("relpath")), F.col("level"), F.col("module"))
    i = i.select(*FILE, F.col("alias").alias("name"), base.alias("module"), F.col("name").alias("target"), "pos")
    bare = F.when(F.col("receiver").isNull(), F.col("callee"))
    guessed = call_ops.fallback_resolve(c.withColumn("name", bare), top, i, modules.select(*FILE, "module")).drop("name")
    if refs is None:
        return guessed.withColumns({"resolution": F.lit("heuristic"), "confidence": F.lit(FALLBACK_CONFIDENCE)})
    at = refs.select(*FILE, ids.node_of_symbol(F.col("service"), F.col("relpath"), F.col("symbol")).alias("symbol"), "start_byte", "end_byte").where("symbol IS NOT NULL")
    met = call_ops.span_join(guessed.withColumnRenamed("symbol", "guess"), at).join(refs.select("service", F.lit(True).alias("read")).distinct(), "service", "left")
    read = F.col("read").isNotNull()
    columns = {"symbol": F.when(read, F.col("symbol")).otherwise(F.col("guess")), "resolution": F.when(read, "static").otherwise("heuristic"), "confidence": F.when(read, 1.0).otherwise(FALLBACK_CONFIDENCE)}
    return met.withColumns(columns).drop("guess", "read")


def symbol_of_name(rows: DataFrame, name: str, parsed: DataFrame, defs: DataFrame, modules: DataFrame, out: str) -> DataFrame:
    """Adds ``out``: the id that a bare or dotted name means in its file (own top-level def, import, or class method)."""
    top = defs.where("parent IS NULL").groupBy(*FILE, "name").agg(F.min("id").alias("symbol"))
    i = facts(parsed, "import").where("name != ''")
    base = ids.resolve_relative_import(ids.containing_package(F.col("relpath")), F.col("level"), F.col("module"))
    i = i.select(*FILE, F.col("alias").alias("name"), base.alias("module"), F.col("name").alias("target"), "pos")
    head, tail = F.split_part(F.col(name), F.lit("."), F.lit(1)), F.when(F.contains(F.col(name), F.lit(".")), F.regexp_replace(F.col(name), r"^[^.]*\.", ""))
    r = call_ops.fallback_resolve(rows.withColumn("name", head), top, i, modules.select(*FILE, "module"))
    method = F.concat("symbol", tail, F.lit("()."))
    return r.withColumn(out, F.when(tail.isNull(), F.col("symbol")).when(F.endswith("symbol", F.lit("#")), method)).drop("name", "symbol")


def call_graph(resolved: DataFrame, local_def_ids: DataFrame) -> DataFrame:
    """CALLS edges: one per caller and callee, with the count and the first site of its calls."""
    hit = resolved.where("symbol IS NOT NULL").join(local_def_ids.select(F.col("id").alias("symbol")), "symbol", "left_semi")
    first = F.min(F.struct("relpath", "pos", "line", "service", "resolution", "confidence"))
    e = hit.groupBy("src", F.col("symbol").alias("dst")).agg(first.alias("f")).select("src", "dst", "f.*")
    return edge_rows(e, "CALLS", F.col("resolution"), F.col("confidence"), extractor="calls")


def routes(parsed: DataFrame, defs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(route claims, mounts): decorated handlers with their router's own prefix, and ``include_router`` calls."""
    made = facts(parsed, "assign").where(F.element_at("ctor", -1).isin(*ROUTERS))
    routers = made.select(*FILE, F.col("target").alias("router"), F.coalesce(F.try_element_at("kwargs", F.lit("prefix")), F.lit("")).alias("own"), (F.element_at("ctor", -1) == "FastAPI").alias("is_root"))
    d = facts(parsed, "decorator").where((F.size("path") == 2) & F.element_at("path", -1).isin(*VERBS) & (F.get("args", F.lit(0))["kind"] == "string"))
    d = d.select(*FILE, F.col("def").alias("idx"), F.get("path", F.lit(0)).alias("router"), F.upper(F.element_at("path", -1)).alias("method"), F.get("args", F.lit(0))["text"].alias("path"), "line")
    claims = d.join(routers, [*FILE, "router"]).join(defs.select(*FILE, "idx", F.col("id").alias("handler")), [*FILE, "idx"])
    mounts = facts(parsed, "call").where("callee = 'include_router'")
    arg = F.get("args", F.lit(0))
    prefix = F.coalesce(F.try_element_at("kwargs", F.lit("prefix"))["text"], F.lit(""))
    mounts = mounts.select(*FILE, F.col("receiver").alias("parent"), arg["text"].alias("child"), prefix.alias("prefix"))
    return claims, mounts


def channel_values(rows: DataFrame, parsed: DataFrame, position: int, keyword: str | None) -> DataFrame:
    """Adds ``channel`` and ``by_value``: the text of the argument that names a channel, a module constant's value, or ``${NAME}`` for a setting."""
    arg = F.get("args", F.lit(position))
    if keyword:
        arg = F.coalesce(F.try_element_at("kwargs", F.lit(keyword)), arg)
    consts = facts(parsed, "const").groupBy(*FILE, F.col("name").alias("__const")).agg(F.last("value").alias("__value"))
    r = rows.withColumn("__arg", arg).withColumn("__const", F.when(F.col("__arg.kind") == "name", F.col("__arg.text"))).join(consts, [*FILE, "__const"], "left")
    literal = F.when(F.col("__arg.kind").isin("string", "fstring"), F.col("__arg.text")).otherwise(F.col("__value"))
    ref = config_ref(F.col("__arg.text"))
    name = F.coalesce(literal, F.when(ref.isNotNull(), F.concat(F.lit("${"), ref, F.lit("}"))))
    return r.withColumn("channel", name).withColumn("by_value", literal.isNotNull()).drop("__arg", "__const", "__value")


def candidates(sites: DataFrame, parsed: DataFrame, patterns: list[str]) -> DataFrame:
    """The sites whose callee ends one of ``patterns``, with what tiers are told by: ``qualified`` (the name of what is called), ``made`` (classes whose instances the file binds to the receiver's name) and ``brought`` (module and name of each import)."""
    lasts = {alternative.split(".")[-1] for pattern in patterns for alternative in pattern.split("|")}
    if not any(set("*?[") & set(last) for last in lasts):
        sites = sites.where(F.col("callee").isin(*lasts))
    made = facts(parsed, "assign").groupBy(*FILE, F.col("target").alias("receiver")).agg(F.collect_set(F.element_at("ctor", -1)).alias("made"))
    base = ids.resolve_relative_import(ids.containing_package(F.col("relpath")), F.col("level"), F.col("module"))
    brought = facts(parsed, "import").groupBy(*FILE).agg(F.collect_set(F.struct(base.alias("module"), F.col("name"))).alias("brought"))
    return sites.join(made, [*FILE, "receiver"], "left").join(brought, FILE, "left").withColumn("qualified", ids.display_name(F.regexp_replace("symbol", "^sym:[^:]*:", "")))


def idiom_tier(pattern: str) -> Column:
    """How surely a candidate is a call of ``pattern`` (alternatives by bars), null if it is none.

    1.0: by the call's own path or by the qualified name of what it calls. 0.8: the receiver is a plain
    name to which the file binds an instance of the class. 0.6: only the name is called, in a file
    that imports the class or the module at the pattern's head.
    """
    steps: dict[float, Column] = {1.0: path_suffix_matches(F.col("path"), pattern), 0.8: F.lit(False), 0.6: F.lit(False)}
    for alternative in pattern.split("|"):
        *up, last = alternative.split(".")
        head = (up or [last])[0]
        called, plain = F.col("callee") == last, F.col("receiver").isNotNull() & ~F.contains("receiver", F.lit("."))
        module = F.exists("brought", lambda i: (i["module"] == head) | F.startswith(i["module"], F.lit(head + ".")))  # noqa: B023
        named = lambda name, source=None: F.exists("brought", lambda i: (i["name"] == name) & (F.lit(True) if source is None else i["module"] == source))
        steps[1.0] |= F.coalesce(wildcard(F.col("qualified"), alternative), F.lit(False))
        if up:
            steps[0.8] |= called & plain & F.array_contains("made", up[-1])
        if last[0].isupper():
            steps[0.6] |= called & (named(last) | (F.col("receiver").isNotNull() & module))
        else:
            steps[0.6] |= called & (module | (named(up[-1], ".".join(up[:-1])) if len(up) > 1 else F.lit(False)))
    return F.coalesce(*(F.when(F.coalesce(fits, F.lit(False)), tier) for tier, fits in steps.items()))


def with_topic(rows: DataFrame, parsed: DataFrame, attributes: DataFrame, topic: Topic) -> DataFrame:
    """Adds ``topic`` and ``topic_by_value``: the topic's name where it can be told, else null.

    A settings field counts if one class of the service fits its name: by its default, else as ``${ENV}``.
    """
    named = topic.env or topic.attr
    if topic.const is not None or named:
        return rows.withColumns({"topic": F.lit(f"${{{named}}}" if named else topic.const), "topic_by_value": F.lit(not named)})
    if topic.settings:
        cls, _, name = topic.settings.rpartition(".")
        one = attributes.where((F.col("name") == name) & wildcard(F.col("class_fqn"), cls)).groupBy("service").agg(F.min("default").alias("__default"), F.min("env_name").alias("__env"), F.count_distinct("class_fqn").alias("__n")).where("__n = 1")
        value = F.coalesce("__default", F.concat(F.lit("${"), "__env", F.lit("}")))
        return rows.join(one, "service", "left").withColumns({"topic": value, "topic_by_value": F.col("__default").isNotNull()}).drop("__default", "__env", "__n")
    kept = rows.withColumnsRenamed({"channel": "__channel", "by_value": "__by_value"})
    found = channel_values(kept, parsed, 2**30 if topic.arg is None else topic.arg, topic.kwarg)
    return found.withColumnsRenamed({"channel": "topic", "by_value": "topic_by_value"}).withColumnsRenamed({"__channel": "channel", "__by_value": "by_value"})


def sure(by_value: str) -> Column:
    """Confidence of a name found by a rule of ``tier``."""
    return combine_confidence(F.col(by_value), F.col("tier"))


def resolution_of(confidence: str) -> Column:
    return F.when(F.col(confidence) == 1.0, "static").otherwise("heuristic")


def containment(rows: DataFrame, event: Column, confidence: Column) -> DataFrame:
    """CONTAINS edges from ``topic`` to the channel ``event``: static if the confidence is whole, else heuristic."""
    named = rows.where("topic != ''").select(ids.channel_id("kafka_topic", F.col("topic")).alias("src"), event.alias("dst"), "service", "relpath", "line", confidence.alias("c"))
    return edge_rows(named.groupBy("src", "dst", "service", "relpath", "line").agg(F.max("c").alias("c")), "CONTAINS", resolution_of("c"), F.col("c"), extractor="kafka")


def united(parts: list[DataFrame]) -> DataFrame | None:
    out = None
    for part in parts:
        out = part if out is None else out.unionByName(part)
    return out


def producers(parsed: DataFrame, sites: DataFrame, rules: tuple[Producer, ...], attributes: DataFrame) -> DataFrame:
    """PRODUCES edges and those of topics to their events; a site belongs to the first rule that fits it."""
    out, left = [], candidates(sites, parsed, [rule.call for rule in rules]) if rules else sites
    for rule in rules:
        tier = idiom_tier(rule.call)
        hit = channel_values(left.withColumn("tier", tier).where("tier IS NOT NULL"), parsed, rule.position, rule.keyword).where("channel IS NOT NULL")
        left = left.where(tier.isNull())
        channel = ids.channel_id(rule.kind, F.col("channel"))
        rows = hit.select("src", channel.alias("dst"), "service", "relpath", "line", sure("by_value").alias("c"))
        out.append(edge_rows(rows, "PRODUCES", resolution_of("c"), F.col("c"), extractor="kafka"))
        if rule.topic is not None and rule.kind == "event_type":
            both = with_topic(hit, parsed, attributes, rule.topic)
            out.append(containment(both, channel, F.least(sure("by_value"), sure("topic_by_value"))))
    return united(out)


def consumers(parsed: DataFrame, sites: DataFrame, defs: DataFrame, modules: DataFrame, rules: tuple[Consumer, ...], attributes: DataFrame) -> DataFrame:
    """CONSUMES edges of subscribing calls, dispatch dicts and typed base classes, and those of topics to the events of the last two."""
    out, called = [], [rule.name for rule in rules if rule.form != "base_class"]
    sites = candidates(sites, parsed, called) if called else sites
    for rule in rules:
        fitting = sites.withColumn("tier", idiom_tier(rule.name)).where("tier IS NOT NULL") if rule.form != "base_class" else None
        if rule.form == "call":
            hit = channel_values(fitting, parsed, rule.position, rule.keyword).where("channel IS NOT NULL")
            rows = hit.select("src", ids.channel_id(rule.kind, F.col("channel")).alias("dst"), "service", "relpath", "line", sure("by_value").alias("c"))
        elif rule.form == "dispatch_dict":
            arg = F.coalesce(F.try_element_at("kwargs", F.lit(rule.keyword or "")), F.get("args", F.lit(rule.position)))
            d = with_topic(fitting, parsed, attributes, rule.topic) if rule.topic else fitting.withColumns({"topic": F.lit(None).cast("string"), "topic_by_value": F.lit(False)})
            d = d.select(*FILE, "line", "tier", "topic", "topic_by_value", F.explode(arg["items"]).alias("item"))
            d = symbol_of_name(d.select(*FILE, "line", "tier", "topic", "topic_by_value", F.col("item.key").alias("key"), F.col("item.value").alias("handler")), "handler", parsed, defs, modules, "src").where("src IS NOT NULL")
            rows = d.select("src", ids.channel_id(rule.kind, F.col("key")).alias("dst"), "service", "relpath", "line", "tier", "topic", "topic_by_value", F.col("tier").alias("c"))
        else:
            base = F.explode(F.filter("bases", lambda b: F.startswith(b, F.lit(rule.name + "["))))
            cls = defs.where("kind = 'Class'").select(*FILE, "idx", base.alias("base"))
            event = F.substring_index(F.regexp_extract("base", r"\[([^\]]+)\]", 1), ".", -1)
            m = defs.where(F.col("name") == rule.handler).select(*FILE, F.col("parent").alias("idx"), F.col("id").alias("src"), F.col("start_line").alias("line"))
            rows = cls.join(m, [*FILE, "idx"]).select("src", ids.channel_id(rule.kind, event).alias("dst"), "service", "relpath", "line", F.lit(1.0).alias("tier"), F.lit(1.0).alias("c"))
            rows = with_topic(rows, parsed, attributes, rule.topic) if rule.topic else rows
        out.append(edge_rows(rows, "CONSUMES", resolution_of("c"), F.col("c"), extractor="kafka"))
        if rule.topic is not None and rule.form != "call" and rule.kind == "event_type":
            out.append(containment(rows, F.col("dst"), sure("topic_by_value")))
    return united(out)


def temporal(parsed: DataFrame, sites: DataFrame, defs: DataFrame, modules: DataFrame) -> dict[str, DataFrame]:
    """roles (id, role), edges (INVOKES_ACTIVITY, signal CONSUMES), start marks and signal sends."""
    d = facts(parsed, "decorator").join(defs.select(*FILE, F.col("idx").alias("def"), "id", "name", "kind", "start_line"), [*FILE, "def"])
    last = F.concat_ws(".", F.slice("path", -2, 2))
    role = F.when(last == "workflow.defn", "TemporalWorkflow").when(last == "activity.defn", "TemporalActivity").when(last.isin("workflow.signal", "workflow.update", "workflow.query"), "TemporalSignalHandler")
    roles = d.where(F.size("path") >= 2).select("id", role.alias("role")).where("role IS NOT NULL").distinct()
    sig = d.where((F.size("path") >= 2) & last.isin("workflow.signal", "workflow.update"))
    name = F.coalesce(F.try_element_at("kwargs", F.lit("name"))["text"], F.col("name"))
    handles = edge_rows(sig.select(F.col("id").alias("src"), ids.channel_id("temporal_signal", name).alias("dst"), "service", "relpath", F.col("start_line").alias("line")), "CONSUMES", extractor="temporal")
    first = F.get("args", F.lit(0))
    acts = sites.where(F.col("callee").isin(*ACTIVITY_CALLS) & (F.col("receiver") == "workflow")).select(*FILE, "src", "line", first["text"].alias("what"))
    acts = symbol_of_name(acts, "what", parsed, defs, modules, "dst").where("dst IS NOT NULL")
    invokes = edge_rows(acts, "INVOKES_ACTIVITY", "heuristic", FALLBACK_CONFIDENCE, extractor="temporal")
    starts = sites.where(F.col("callee").isin(*START_CALLS)).select(*FILE, "src", "line", first["text"].alias("what"))
    starts = symbol_of_name(starts, "what", parsed, defs, modules, "dst").where("dst IS NOT NULL").select("src", "dst", "line")
    send = sites.where("callee = 'signal' AND receiver != 'workflow'")
    texts = send.where(first["kind"] == "string").select(*FILE, "src", "line", ids.channel_id("temporal_signal", first["text"]).alias("dst"))
    produced = edge_rows(texts, "PRODUCES", "heuristic", FALLBACK_CONFIDENCE, extractor="temporal")
    symbols = symbol_of_name(send.where(first["kind"] != "string").select(*FILE, "src", "line", first["text"].alias("what")), "what", parsed, defs, modules, "method_symbol")
    sends = symbols.where("method_symbol IS NOT NULL").select(F.col("src").alias("src_id"), "method_symbol", "line")
    return {"roles": roles, "edges": handles.unionByName(invokes).unionByName(produced), "starts": starts, "sends": sends}


def verb_calls(inside: DataFrame, rules: list[tuple[int, HttpClient]]) -> DataFrame:
    """Calls ``x.get("/path")`` and the like in a client class, by the first rule that fits."""
    nth = F.coalesce(F.lit(None).cast("int"), *(F.when(of_client(rule), F.lit(k)) for k, rule in rules))
    arg = F.get("args", F.lit(0))
    path, hint = claimed_path(arg["kind"], arg["text"])
    hit = inside.where(nth.isNotNull() & F.col("callee").isin(*VERBS) & F.col("receiver").isNotNull() & arg["kind"].isin("string", "fstring"))
    return hit.select(*FILE, "idx", nth.alias("nth"), "src", F.upper("callee").alias("method"), path.alias("path"), hint.alias("hint"), "line", "cls").where("path IS NOT NULL")


def role_props(roles: DataFrame, routes: DataFrame, defs: DataFrame) -> DataFrame:
    """id, add_props: a workflow's name, and the method and path of a handler's first route."""
    flows = roles.where("role = 'TemporalWorkflow'").select("id").distinct().join(defs.select("id", "name"), "id")
    first = routes.groupBy(F.col("handler").alias("id")).agg(F.min(F.struct("line", "method", "path")).alias("r"))
    flows = flows.select("id", F.create_map(F.lit("workflow_name"), "name").alias("add_props"))
    handlers = first.select("id", F.create_map(F.lit("http_method"), F.col("r.method"), F.lit("path_template"), F.col("r.path")).alias("add_props"))
    return flows.unionByName(handlers.join(flows.select("id"), "id", "left_anti"))


def of_client(rule: HttpClient) -> Column:
    return wildcard(F.substring_index("relpath", "/", -1), rule.file_glob) & wildcard(F.col("cls_name"), rule.class_glob)


def claimed_path(kind: Column, text: Column) -> tuple[Column, Column]:
    """(path, hint) of a text; the path is null if it does not start with a slash or a base."""
    path = F.when(F.startswith(text, F.lit("<base>")), F.substring(text, 7, 2**31 - 1)).when(F.startswith(text, F.lit("/")), text)
    return path, F.when((kind == "fstring") & F.startswith(text, F.lit("/")), "heuristic").otherwise("static")


def decorated_calls(parsed: DataFrame, inside: DataFrame, defs: DataFrame, cls: DataFrame, nth: int, rule: HttpClient) -> DataFrame:
    """Of each method of a client class with a route's decorator: the first call that sends, with the verb of the first request made.

    Methods without either are left out. Both may stand in functions inside the method.
    """
    owner = defs.where("kind = 'Function'").select(*FILE, F.col("idx").alias("method_idx"), F.col("id").alias("src"), F.explode("ancestors").alias("cls")).join(cls, [*FILE, "cls"])
    nearest = F.max(F.struct("cls", "cls_name")).alias("c")
    owner = owner.groupBy(*FILE, "method_idx", "src").agg(nearest).select(*FILE, "method_idx", "src", "c.*").where(of_client(rule))
    given = facts(parsed, "decorator").where(F.try_element_at("path", F.lit(-1)) == rule.route_from.decorator).withColumn("given", F.get("args", F.lit(rule.route_from.arg))["kind"])
    given = channel_values(given, parsed, rule.route_from.arg, None).where("by_value")
    path, hint = claimed_path(F.col("given"), F.col("channel"))
    routes = given.select(*FILE, F.col("def").alias("method_idx"), "line", path.alias("path"), hint.alias("hint")).where("path IS NOT NULL")
    routes = routes.groupBy(*FILE, "method_idx").agg(F.min(F.struct("line", "path", "hint")).alias("r")).select(*FILE, "method_idx", F.col("r.path").alias("path"), F.col("r.hint").alias("hint"))
    first = F.get("args", F.lit(0))
    verb = F.when(path_suffix_matches(F.col("path"), rule.verb_from.request_ctor) & (first["kind"] == "attr") & (F.regexp_replace(first["text"], r"\.[^.]*$", "") == rule.verb_from.enum), F.upper(F.substring_index(first["text"], ".", -1)))
    sends = path_suffix_matches(F.col("path"), rule.call)
    calls = inside.select(*FILE, "method_idx", "idx", "line", verb.alias("verb"), sends.alias("sends")).where("sends OR verb IS NOT NULL")
    sent = calls.groupBy(*FILE, "method_idx").agg(F.min(F.when(F.col("sends"), F.struct("idx", "line"))).alias("s"), F.min(F.when(F.col("verb").isNotNull(), F.struct("idx", "verb"))).alias("v")).where("s IS NOT NULL AND v IS NOT NULL")
    met = owner.join(routes, [*FILE, "method_idx"]).join(sent, [*FILE, "method_idx"])
    return met.select(*FILE, F.col("s.idx").alias("idx"), F.lit(nth).alias("nth"), "src", F.col("v.verb").alias("method"), "path", "hint", F.col("s.line").alias("line"), "cls")


def http_calls(parsed: DataFrame, sites: DataFrame, defs: DataFrame, rules: tuple[HttpClient, ...]) -> DataFrame:
    """src, method, path, hint, service, relpath, line, idx, cls: what client classes call, each call claimed once, by the first rule that fits."""
    cls = defs.where("kind = 'Class'").select(*FILE, F.col("idx").alias("cls"), F.col("name").alias("cls_name"))
    fn = defs.select(*FILE, F.col("idx").alias("encl"), F.explode("ancestors").alias("cls"))
    by_verb = [(k, rule) for k, rule in enumerate(rules) if rule.route_from is None]
    found = verb_calls(sites.join(fn, [*FILE, "encl"]).join(cls, [*FILE, "cls"]), by_verb)
    if len(by_verb) < len(rules):
        within = defs.where("kind = 'Function'").select(*FILE, F.col("idx").alias("encl"), F.explode(F.array_append("ancestors", F.col("idx"))).alias("method_idx"))
        inside = sites.join(within, [*FILE, "encl"])
        for k, rule in enumerate(rules):
            if rule.route_from is not None:
                found = found.unionByName(decorated_calls(parsed, inside, defs, cls, k, rule))
    claim = F.min(F.struct("nth", "cls", "src", "method", "path", "hint", "line")).alias("c")
    return found.groupBy(*FILE, "idx").agg(claim).select("c.src", "c.method", "c.path", "c.hint", *FILE, "c.line", "idx", "c.cls")


def base_url_envs(parsed: DataFrame, defs: DataFrame, attributes: DataFrame) -> DataFrame:
    """service, relpath, cls, env: the environment name behind what a class assigns to its own attributes, if there is one only.

    Either the value reads the environment itself, or its last name is a settings field that exactly
    one class of the service declares with an environment name.
    """
    a = facts(parsed, "self_attr").join(defs.select(*FILE, F.col("idx").alias("encl"), F.explode("ancestors").alias("cls")), [*FILE, "encl"])
    direct = F.regexp_extract("value", r"(?:environ\s*\[|environ\.get\(|getenv\()\s*['\"]([A-Za-z_][A-Za-z0-9_]*)['\"]", 1)
    fields = attributes.where("env_name IS NOT NULL").select("service", F.col("name").alias("field"), "class_fqn", "env_name")
    one = fields.groupBy("service", "field").agg(F.min("env_name").alias("env_name"), F.count_distinct("class_fqn").alias("n")).where("n = 1").drop("n")
    met = a.withColumns({"direct": F.when(direct != "", direct), "field": F.regexp_extract("value", r"\.([A-Za-z_]\w*)$", 1)}).join(one, ["service", "field"], "left")
    env = F.coalesce("direct", "env_name")
    return met.where(env.isNotNull()).groupBy(*FILE, "cls").agg(F.min(env).alias("env"), F.count_distinct(env).alias("n")).where("n = 1").drop("n")


def class_attributes(parsed: DataFrame, defs: DataFrame) -> DataFrame:
    """class_fqn, name, default, env_name, is_enum: settings fields (alias, else prefix and name in capitals) and enum values."""
    a = facts(parsed, "class_attr")
    c = defs.where("kind = 'Class'").select(*FILE, F.col("idx").alias("cls"), F.concat_ws(".", "module", "qualname").alias("class_fqn"), "bases")
    prefix = a.where("name = 'model_config'").select(*FILE, "cls", F.regexp_extract(F.col("value.text"), r"env_prefix\s*=\s*['\"]([^'\"]*)", 1).alias("prefix"))
    rows = a.where("name != 'model_config'").join(c, [*FILE, "cls"]).join(prefix, [*FILE, "cls"], "left")
    settings = F.exists("bases", lambda b: F.endswith(b, F.lit("BaseSettings")))
    enum = F.exists("bases", lambda b: b.rlike(r"(^|\.)(Str)?Enum$"))
    every = F.bool_and(F.col("value.kind") == "string").over(Window.partitionBy(*FILE, "cls"))
    env = F.when(settings, F.coalesce("alias", F.concat(F.coalesce("prefix", F.lit("")), F.upper("name"))))
    return rows.select(*FILE, "class_fqn", "name", F.when(F.col("value.kind") == "string", F.col("value.text")).alias("default"), env.alias("env_name"), (enum & every).alias("is_enum"))


def singletons(parsed: DataFrame, modules: DataFrame) -> DataFrame:
    """Module-level ``name = Class(...)``: service, relpath, name, class_name; a class name starts with a capital after underscores."""
    a = facts(parsed, "assign").where("encl IS NULL")
    cls = F.element_at("ctor", -1)
    return a.where(cls.rlike("^_*[A-Z]")).select(*FILE, F.col("target").alias("name"), cls.alias("class_name"))


def singleton_calls(sites: DataFrame, single: DataFrame, defs: DataFrame) -> DataFrame:
    """CALLS through a module's singleton in the same file: the only method of that name of the only class of that name."""
    one = single.groupBy(*FILE, "name").agg(F.min("class_name").alias("class_name"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    methods = defs.where("kind = 'Function' AND parent IS NOT NULL").select("service", F.regexp_extract("descriptor", r"(\w+)#(\w+)\(\)\.$", 1).alias("class_name"), F.col("name").alias("callee"), "id")
    methods = methods.groupBy("service", "class_name", "callee").agg(F.min("id").alias("dst"), F.count(F.lit(1)).alias("n")).where("n = 1")
    hit = sites.join(one.withColumnRenamed("name", "receiver"), [*FILE, "receiver"]).join(methods, ["service", "class_name", "callee"])
    return edge_rows(hit.select("src", "dst", "service", "relpath", "line").dropDuplicates(["src", "dst"]), "CALLS", "heuristic", FALLBACK_CONFIDENCE, extractor="calls")


def dependencies(sites: DataFrame, handlers: DataFrame, parsed: DataFrame, defs: DataFrame, modules: DataFrame) -> DataFrame:
    """DEPENDS_ON edges: what a route's handler asks to be given by ``Depends(...)``, as a default or in an annotation."""
    asked = sites.where("callee = 'Depends'").join(handlers.select(F.col("handler").alias("src")).distinct(), "src", "left_semi")
    asked = asked.select(*FILE, "src", "line", F.get("args", F.lit(0))["text"].alias("what")).where("what IS NOT NULL")
    found = symbol_of_name(asked, "what", parsed, defs, modules, "dst").where("dst IS NOT NULL")
    return edge_rows(found.select("src", "dst", "service", "relpath", "line").dropDuplicates(["src", "dst"]), "DEPENDS_ON", extractor="fastapi")


def enum_producers(sites: DataFrame, attributes: DataFrame, rule: Producer) -> DataFrame:
    """One PRODUCES edge (heuristic 0.8) for each value of the enum that names the channel, where the enum's name is unique in its service."""
    arg = F.get("args", F.lit(rule.position))
    if rule.keyword:
        arg = F.coalesce(F.try_element_at("kwargs", F.lit(rule.keyword)), arg)
    values = attributes.where("is_enum").select("service", F.substring_index("class_fqn", ".", -1).alias("enum"), "class_fqn", F.col("default").alias("value"))
    unique = values.groupBy("service", "enum").agg(F.count_distinct("class_fqn").alias("n")).where("n = 1").drop("n")
    hit = sites.where(path_suffix_matches(F.col("path"), rule.call)).withColumn("enum", F.regexp_extract(arg["text"], r"^(\w+)\(", 1))
    met = hit.join(unique, ["service", "enum"]).join(values, ["service", "enum"])
    rows = met.select("src", ids.channel_id(rule.kind, F.col("value")).alias("dst"), "service", "relpath", "line").dropDuplicates(["src", "dst"])
    return edge_rows(rows, "PRODUCES", "heuristic", 0.8, extractor="kafka")
