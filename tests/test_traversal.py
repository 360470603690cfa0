"""Golden mini-graphs and the boundary of every cap."""

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import chunks, evaluate, graph, link, staging, trace
from weftgraph.operators.dedup import dedup_edges

EDGE = "src string, dst string, type string, via_channel string, origin_service string, resolution string, confidence double"


def made(spark, rows):
    return spark.createDataFrame([(r[0], r[1], r[2], *(r[3:] or ("", "", "static", 1.0))) for r in rows], EDGE)


def nodes(spark, rows):
    return spark.createDataFrame(rows, "id string, service string, roles array<string>")


def chain(n):
    return [(f"f{k:02d}", f"f{k + 1:02d}", "CALLS") for k in range(n)]


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "id string")


def test_three_segments(spark):
    event, http = "chan:event_type:OrderCreated", "chan:http:docs:GET /documents/{id}"
    e = made(spark, [("create", "save", "CALLS"), ("save", event, "PRODUCES"), ("on_order", event, "CONSUMES"), ("on_order", "flow", "CALLS"), ("flow", "verify", "INVOKES_ACTIVITY"),
                     ("verify", http, "CALLS_HTTP"), (http, "get_doc", "HANDLES"), ("save", "on_order", "NEXT_SEGMENT", event, "", "static", 1.0), ("verify", "get_doc", "NEXT_SEGMENT", http, "", "static", 1.0)])
    n = nodes(spark, [(x, s, ["R"]) for x, s in [("create", "orders"), ("save", "orders"), ("on_order", "kyc"), ("flow", "kyc"), ("verify", "kyc"), ("get_doc", "docs")]])
    got = trace.trace_process(e, n, "create")
    assert [(s["service"], s["entry"]) for s in got["segments"]] == [("orders", "create"), ("kyc", "on_order"), ("docs", "get_doc")]
    assert (got["confidence"], got["truncated"], got["external_exit_count"]) == (1.0, False, 0)
    assert "OrderCreated" in trace.tree(got) and trace.mermaid(got).startswith("flowchart TD")
    assert trace.trace_process(e, n, "create", max_segments=2)["truncated"]
    assert trace.trace_process(e, n, "nobody")["segments"] == []


@pytest.mark.parametrize(("length", "truncated"), [(15, False), (16, True)])
def test_segment_depth(spark, length, truncated):
    e = made(spark, chain(length))
    steps, over = graph.walk_segments(e, ids(spark, "f00"))
    assert steps.count() == 15 and over.first().truncated == truncated
    assert trace.walk(e, "f00", 0.3)["truncated"] == truncated


def test_capped_node_with_only_a_weak_hop_does_not_truncate(spark):
    e = made(spark, [*chain(15), ("f15", "x", "CALLS", "", "", "heuristic", 0.1)])
    assert not graph.walk_segments(e, ids(spark, "f00"))[1].first().truncated
    assert not trace.walk(e, "f00", 0.3)["truncated"]


@pytest.mark.parametrize(("width", "truncated"), [(8, False), (9, True)])
def test_branch_cap(spark, width, truncated):
    e = made(spark, [("a", f"b{k}", "CALLS") for k in range(width)])
    steps, over = graph.walk_segments(e, ids(spark, "a"))
    assert steps.count() == 8 and over.first().truncated == truncated


def test_repeated_node_is_a_step_but_is_walked_once(spark):
    e = made(spark, [("a", "b", "CALLS"), ("a", "c", "CALLS"), ("b", "d", "CALLS"), ("c", "d", "CALLS"), ("d", "a", "CALLS"), ("d", "e", "CALLS")])
    steps, _ = graph.walk_segments(e, ids(spark, "a"))
    assert [(r["at"], r.neighbor) for r in steps.orderBy("level", "key").collect()] == [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e")]
    assert [(r.src, r.dst) for r in trace.walk(e, "a", 0.3)["steps"]] == [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "a"), ("d", "e")]


@pytest.mark.parametrize(("steps", "protected", "shown"), [(15, [], 15), (16, [], 6), (16, [6], 6 + 1 + 6), (16, [7], 6 + 1 + 6), (17, [5, 12], 5 + 1 + 6 + 1 + 4)])
def test_compaction(spark, steps, protected, shown):
    rows = spark.createDataFrame([("s", k, k in protected) for k in range(steps)], "start string, nth int, p boolean")
    got = graph.compact(rows, F.col("p")).orderBy("nth").collect()
    assert len(got) == shown
    hidden = sum(r.collapsed - 1 for r in got if r.collapsed)
    assert len(got) + hidden == steps


def test_expand_budget_and_direction(spark):
    e = made(spark, [("a", f"b{k}", "CALLS") for k in range(5)] + [("z", "a", "CALLS")])
    hops, over = graph.expand(e, ids(spark, "a"), None, "both", 1, 6)
    assert hops.count() == 6 and not over.first().truncated
    hops, over = graph.expand(e, ids(spark, "a"), None, "both", 1, 5)
    assert hops.count() == 5 and over.first().truncated and hops.where("direction = 'in'").count() == 0
    with pytest.raises(ValueError, match="direction"):
        graph.hops(e, None, "up")


def test_callers_of_an_activity_and_of_a_cycle(spark):
    n = nodes(spark, [("act", "s", ["TemporalActivity"]), ("fn", "s", []), ("flow", "s", []), ("top", "s", [])])
    e = made(spark, [("flow", "act", "INVOKES_ACTIVITY"), ("top", "flow", "CALLS"), ("act", "top", "CALLS"), ("flow", "fn", "INVOKES_ACTIVITY")])
    got = {(r.node, r.level, r.via_activity) for r in graph.who_calls(e, n, ids(spark, "act"), True, 5).collect()}
    assert got == {("flow", 1, True), ("top", 2, True), ("act", 3, True)}
    assert graph.who_calls(e, n, ids(spark, "fn"), True, 3).count() == 0


def test_paths(spark):
    e = made(spark, [("a", "b", "CALLS"), ("c", "b", "CALLS"), ("a", "x", "CALLS"), ("x", "c", "CALLS")])
    pairs = spark.createDataFrame([("a", "c"), ("a", "a"), ("a", "nowhere")], "start string, goal string")
    got = {r.goal: r.path for r in graph.shortest_paths(e, pairs, None, 5).collect()}
    assert [(h.node, h.direction) for h in got["c"]] == [("b", "out"), ("c", "in")]
    assert got["a"] == [] and got["nowhere"] is None


@pytest.mark.parametrize(("rows", "want"), [
    ([("x", "E", "PRODUCES", "", "", "static", 0.9), ("y", "E", "CONSUMES", "", "", "static", 0.8)], {("x", "y", "E", "static", 0.72)}),
    ([("x", "E", "PRODUCES", "", "", "heuristic", 0.9), ("y", "E", "CONSUMES", "", "", "static", 1.0)], {("x", "y", "E", "heuristic", 0.9)}),
    ([("x", "chan:E", "PRODUCES"), ("chan:T", "chan:E", "CONTAINS"), ("y", "chan:T", "CONSUMES")], {("x", "y", "chan:E", "static", 1.0)}),
    ([("x", "chan:T", "PRODUCES"), ("chan:T", "chan:E", "CONTAINS"), ("y", "chan:E", "CONSUMES")], set()),
    ([("x", "E", "PRODUCES"), ("x", "E", "CONSUMES")], set()),
    ([("x", "E", "PRODUCES"), ("y", "E", "CONSUMES"), ("x", "H", "CALLS_HTTP"), ("H", "y", "HANDLES")], {("x", "y", "E", "static", 1.0), ("x", "y", "H", "static", 1.0)}),
])
def test_hand_offs(spark, rows, want):
    assert {(r.src, r.dst, r.via_channel, r.resolution, r.confidence) for r in link.next_segments(made(spark, rows)).collect()} == want


@pytest.mark.parametrize(("routes", "path", "allowed", "want"), [
    ([("s", "/orders/{id}")], "/orders/42", None, ("s", "unanchored", 0.7)),
    ([("s", "/a/b")], "/a/{x}", None, ("?", "unresolved", 0.5)),
    ([("s", "/{a}/{b}/{c}/parsed-data")], "/api/v1/steps/{step_uid}", None, ("?", "unresolved", 0.5)),
    ([("s", "/orders/{id}"), ("t", "/orders/{id}")], "/orders/1", "s", ("s", "anchored", 1.0)),
    ([("s", "/orders/{id}"), ("s", "/orders/{n}")], "/orders/1", "s", ("?", "unresolved", 0.5)),
    ([("s", "/x/{}")], "/x/1", None, ("?", "unresolved", 0.5)),
])
def test_route_links(spark, routes, path, allowed, want):
    r = spark.createDataFrame([(o, "GET", t) for o, t in routes], "owner string, method string, template string")
    c = spark.createDataFrame([(1, "GET", path, allowed)], "claim_id int, method string, path string, allowed string")
    got = link.link_routes(c, r).first()
    assert (got.owner, got.tier, got.confidence) == want


@pytest.mark.parametrize(("ways", "over"), [(16, False), (17, True)])
def test_router_prefix_overflow_is_contagious(spark, ways, over):
    rows = [("root", "mid", f"/{k}") for k in range(ways)] + [("mid", "leaf", "/x"), ("leaf", "mid", "/cycle")]
    mounts = spark.createDataFrame(rows, "parent string, child string, prefix string")
    got = link.router_prefixes(mounts, spark.createDataFrame([("root",)], "router string")).collect()
    leaf = [r.prefix for r in got if r.router == "leaf"]
    assert leaf == [None] if over else sorted(leaf) == sorted(f"/{k}/x" for k in range(ways))


def test_process_member_cap(spark):
    hand = spark.createDataFrame([("e", f"m{k:03d}", "static", 1.0) for k in range(150)], "src string, dst string, resolution string, confidence double")
    declared = spark.createDataFrame([("p", "e")], "process string, entry string")
    assert link.part_of_process(hand, declared).count() == 100


def test_dedup_prefers_resolution_then_confidence_then_origin(spark):
    e = made(spark, [("a", "b", "CALLS", "", "z", "heuristic", 1.0), ("a", "b", "CALLS", "", "y", "static", 0.5), ("a", "b", "CALLS", "", "x", "static", 0.9), ("a", "b", "CALLS", "", "w", "static", 0.9), ("a", "b", "CALLS", "v", "w", "other", 0.1)])
    assert {(r.via_channel, r.origin_service, r.confidence) for r in dedup_edges(e).collect()} == {("", "w", 0.9), ("v", "w", 0.1)}


def test_cross_service_rule(spark):
    e = made(spark, [("sym:a:x", "sym:b:y", "CALLS"), ("sym:a:x", "sym:b:y", "NEXT_SEGMENT", "chan:e", "", "static", 1.0), ("sym:a:x", "sym:b:y", "NEXT_SEGMENT"), ("sym:a:x", "chan:e", "PRODUCES"), ("svc:a", "sym:a:x", "CONTAINS")])
    assert {(r.src, r.dst, r.type) for r in staging.crosses_services(e).collect()} == {("sym:a:x", "sym:b:y", "CALLS"), ("sym:a:x", "sym:b:y", "NEXT_SEGMENT")}


@pytest.mark.parametrize(("lines", "pieces"), [(["a" * 1999 + "\n"], 1), (["a" * 1000, "\n", "b" * 1000], 2), (["é" * 1500], 1), (["a\n"] * 1001, 2), (["x" * 5000 + "\n", "y\n"], 2), ([""], 0)])
def test_packing_by_bytes(spark, lines, pieces):
    text = "".join(lines)
    got = spark.createDataFrame([(1, text)], "id int, text string").select(chunks.pack_lines(F.col("text")).alias("p")).first().p
    assert "".join(got) == text and len(got) == pieces
    assert all(len(p.encode()) <= 2000 or p.count("\n") <= 1 for p in got)


def test_precision_recall_of_empty_sets(spark):
    rows = made(spark, [("a", "b", "CALLS")])
    none = rows.limit(0)
    got = lambda f, g: (lambda r: (r.precision, r.recall))(evaluate.precision_recall(f, g, ["src", "dst"]).first())
    assert got(none, rows) == (1.0, 0.0) and got(rows, none) == (0.0, 1.0) and got(rows, rows) == (1.0, 1.0)
