"""Hops, bounded traversals and shortest paths, for many starts at once, level by level.

A traversal carries ``start`` so that one run serves any number of starts. Levels are joins of the
frontier with the edges; nodes seen before leave by an anti join. Traversals of more than three
levels write each level to the checkpoint folder, which keeps plans short and survives lost executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftgraph.schema import EXIT_TYPES, STEP_TYPES
from weftgraph.session import cut

MAX_DEPTH, MAX_CALL_DEPTH, MAX_PATH_HOPS, SEGMENT_DEPTH, BRANCHES, FETCHED = 3, 5, 12, 15, 8, 50


def above(floor: float) -> Column:
    """Confidence at or above the floor; none at all counts as certain."""
    return F.coalesce("confidence", F.lit(1.0)) >= floor


def of_types(edges: DataFrame, types: list[str] | None) -> DataFrame:
    return edges.where(F.col("type").isin(*types)) if types else edges


def hops(edges: DataFrame, types: list[str] | None = None, direction: str = "both") -> DataFrame:
    """at, edge_type, neighbor, direction: every edge as it is met from an end; ``both`` lists out before in."""
    if direction not in ("out", "in", "both"):
        raise ValueError(f"direction must be out, in or both: {direction}")
    wanted = of_types(edges, types)
    extra = [F.col(c) for c in ("confidence", "resolution") if c in edges.columns]
    out = wanted.select(F.col("src").alias("at"), F.col("type").alias("edge_type"), F.col("dst").alias("neighbor"), F.lit("out").alias("direction"), *extra)
    back = wanted.select(F.col("dst").alias("at"), F.col("type").alias("edge_type"), F.col("src").alias("neighbor"), F.lit("in").alias("direction"), *extra)
    return out if direction == "out" else back if direction == "in" else out.unionByName(back)


def neighbors(edges: DataFrame, ids: DataFrame, types: list[str] | None = None, direction: str = "both", limit: int | None = None) -> DataFrame:
    """id, edge_type, neighbor, direction for each id; with a limit, the first by (out before in, type, neighbor)."""
    found = hops(edges, types, direction).withColumnRenamed("at", "id").join(ids.select("id").distinct(), "id", "left_semi").select("id", "edge_type", "neighbor", "direction")
    if limit is None:
        return found
    order = Window.partitionBy("id").orderBy(F.col("direction") == "in", "edge_type", "neighbor")
    return found.withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit).drop("k")


def unseen(front: DataFrame, seen: DataFrame) -> DataFrame:
    """The distinct (start, node) of a new frontier that were not met before."""
    return front.select("start", "node").distinct().join(seen.select("start", "node"), ["start", "node"], "left_anti")


def reach(edges: DataFrame, starts: DataFrame, types: list[str] | None = None, direction: str = "out", depth: int = 1) -> DataFrame:
    """start, node, level: every node within ``depth`` hops and its distance (the start at 0)."""
    step = hops(edges, types, direction).select("at", "neighbor").distinct()
    seen = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.lit(0).alias("level"))
    front = seen
    for level in range(1, depth + 1):
        met = front.select("start", F.col("node").alias("at")).join(step, "at").select("start", F.col("neighbor").alias("node"))
        front = unseen(met, seen).withColumn("level", F.lit(level))
        if depth > 3:
            front = cut(front)
            if front.isEmpty():
                break
        seen = seen.unionByName(front)
    return seen


def expand(edges: DataFrame, starts: DataFrame, types: list[str] | None = None, direction: str = "both", depth: int = 1, limit: int = 50) -> tuple[DataFrame, DataFrame]:
    """(hops, truncated): hops level by level within a total budget per start; hops into seen nodes are still listed.

    hops: start, level, at, edge_type, neighbor, direction; truncated: start, truncated.
    """
    depth = max(1, min(MAX_DEPTH, depth))
    props = [c for c in ("confidence", "resolution") if c in edges.columns]
    step = hops(edges, types, direction).select("at", "edge_type", "neighbor", "direction", *props)
    front = starts.select(F.col("id").alias("start"), F.col("id").alias("at")).distinct()
    seen, every = front.select("start", F.col("at").alias("node")), None
    for level in range(depth):
        met = front.join(step, "at").select("start", F.lit(level).alias("level"), "at", "edge_type", "neighbor", "direction", *props)
        if level + 1 < depth:  # starts over their budget are not walked further
            met = cut(met)
        every = met if every is None else every.unionByName(met)
        if level + 1 < depth:
            full = every.groupBy("start").count().where(F.col("count") > limit)
            front = unseen(met.select("start", F.col("neighbor").alias("node")), seen).join(full, "start", "left_anti")
            front = cut(front.select("start", F.col("node").alias("at")))
            seen = seen.unionByName(front.select("start", F.col("at").alias("node")))
    order = Window.partitionBy("start").orderBy("level", "at", F.col("direction") == "in", "edge_type", "neighbor")
    ranked = every.withColumn("k", F.row_number().over(order))
    over = ranked.groupBy("start").agg(F.max(F.col("k") > limit).alias("truncated"))
    return ranked.where(F.col("k") <= limit).drop("k"), over


def who_calls(edges: DataFrame, nodes: DataFrame, targets: DataFrame, transitive: bool = False, max_depth: int = 3, limit: int = 50) -> DataFrame:
    """start, node, level, via_activity: callers of each target, nearest first, at most ``limit``.

    Calls count; if the target is an activity, its invocations too, at every level. A caller found
    through an invocation keeps that mark. A cycle may return the target itself.
    """
    depth = max(1, min(MAX_CALL_DEPTH, max_depth)) if transitive else 1
    activity = nodes.select(F.col("id").alias("start"), F.coalesce(F.array_contains("roles", "TemporalActivity"), F.lit(False)).alias("activity"))
    front = targets.select(F.col("id").alias("start")).distinct().join(activity, "start").select("start", "activity", F.col("start").alias("node"), F.lit(False).alias("via_activity"))
    back = edges.where(F.col("type").isin("CALLS", "INVOKES_ACTIVITY")).select(F.col("dst").alias("node"), F.col("src").alias("caller"), (F.col("type") == "INVOKES_ACTIVITY").alias("invoked"))
    seen = None
    for level in range(1, depth + 1):
        met = front.join(back, "node").where("activity OR NOT invoked")
        met = met.groupBy("start", "activity", "caller").agg(F.bool_or(F.col("via_activity") | F.col("invoked")).alias("via_activity"))
        new = met.select("start", "activity", F.col("caller").alias("node"), F.lit(level).alias("level"), "via_activity")
        if seen is not None:
            new = new.join(seen.select("start", "node"), ["start", "node"], "left_anti")
        new = cut(new) if depth > 3 else new
        seen = new if seen is None else seen.unionByName(new)
        front = new.select("start", "activity", "node", "via_activity")
    order = Window.partitionBy("start").orderBy("level", "node")
    return seen.withColumn("k", F.row_number().over(order)).where(F.col("k") <= limit).select("start", "node", "level", "via_activity")


def shortest_paths(edges: DataFrame, pairs: DataFrame, types: list[str] | None = None, max_hops: int = 8, fetched: int = FETCHED) -> DataFrame:
    """start, goal, path: shortest path whatever the direction of edges; ties by (type, neighbor) in frontier order.

    ``path`` is an array of (edge_type, node, direction) from the start's first hop; empty if start
    and goal are one; null if there is none within the limit.

    One frontier goes on from the starts, one back from the goals, each for all pairs that share an
    end; the smaller one takes the next level. Pairs of a distance meet at the level at which both
    make up that distance. A least path is the least of its first part and then of its second, so a
    node keeps one of each.
    """
    max_hops = max(1, min(MAX_PATH_HOPS, max_hops))
    step = hops(edges, types, "both").select("at", F.struct("edge_type", F.col("neighbor").alias("node"), "direction").alias("hop"))
    order = Window.partitionBy("at").orderBy("hop")
    # equal hops have one rank; they are made one where they lie
    step = step.withColumn("k", F.dense_rank().over(order)).where(F.col("k") <= fetched).select("at", "hop").distinct()
    step = cut(step)
    empty = F.array().cast("array<struct<edge_type:string,node:string,direction:string>>")
    pairs = cut(pairs.select("start", "goal").distinct())
    done = pairs.where("start = goal").select("start", "goal", empty.alias("path"))
    left = cut(pairs.where("start != goal"))
    ends = {end: cut(left.select(end, F.col(end).alias("node"), empty.alias("path")).distinct()) for end in ("start", "goal")}
    seen = {end: front.select(end, "node") for end, front in ends.items()}
    for _ in range(max_hops):
        sizes = {end: front.count() for end, front in ends.items()}
        if not all(sizes.values()):
            break
        end = min(sizes, key=sizes.get)
        front = ends[end].join(left.select(end).distinct(), end, "left_semi")
        if end == "start":
            met = front.withColumnRenamed("node", "at").join(step, "at").select(end, F.col("hop.node").alias("node"), F.array_append("path", F.col("hop")).alias("path"))
        else:
            met = front.join(step, F.col("hop.node") == F.col("node")).select(end, F.col("at").alias("node"), F.array_prepend("path", F.col("hop")).alias("path"))
        met = met.join(seen[end], [end, "node"], "left_anti").groupBy(end, "node").agg(F.min("path").alias("path"))
        ends[end] = cut(met)
        seen[end] = seen[end].unionByName(ends[end].select(end, "node"))
        whole = F.concat("path", "rest").alias("path")
        found = left.join(ends["start"], "start").join(ends["goal"].withColumnRenamed("path", "rest"), ["goal", "node"]).select("start", "goal", whole)
        found = cut(found.groupBy("start", "goal").agg(F.min("path").alias("path")))
        done = done.unionByName(found)
        left = cut(left.join(found.select("start", "goal"), ["start", "goal"], "left_anti"))
    return pairs.join(done, ["start", "goal"], "left")


def segment_hops(edges: DataFrame, floor: float) -> DataFrame:
    """at, k, of, edge_type, neighbor, confidence: the onward hops of a node above the floor, in order, and how many there are."""
    onward = of_types(edges, [*STEP_TYPES, *EXIT_TYPES]).where(above(floor))
    w = Window.partitionBy("at")
    h = onward.select(F.col("src").alias("at"), F.col("type").alias("edge_type"), F.col("dst").alias("neighbor"), "confidence", "resolution")
    return h.withColumns({"k": F.row_number().over(w.orderBy("edge_type", "neighbor")), "of": F.count(F.lit(1)).over(w)}).where(F.col("k") <= BRANCHES)


def walk_segments(edges: DataFrame, entries: DataFrame, floor: float = 0.3, depth: int = SEGMENT_DEPTH) -> tuple[DataFrame, DataFrame]:
    """(hops, truncated) of the segment that starts at each entry.

    hops: start, level, key, at, edge_type, neighbor, confidence, exit; ordered by (level, key) they
    are in breadth-first order. A repeated node is a step but is not walked again. A node at the
    depth limit truncates only if it has an onward hop.
    """
    step = cut(segment_hops(edges, floor))
    empty = F.array().cast("array<int>")
    front = cut(entries.select(F.col("id").alias("start"), F.col("id").alias("node"), empty.alias("key")).dropDuplicates(["start"]))
    seen, found, cuts = front.select("start", "node"), None, None
    for level in range(depth):
        met = front.withColumnRenamed("node", "at").join(step, "at")
        met = cut(met.select("start", F.lit(level).alias("level"), F.array_append("key", F.col("k")).alias("key"), "at", "edge_type", "neighbor", "confidence", F.col("edge_type").isin(*EXIT_TYPES).alias("exit"), (F.col("of") > BRANCHES).alias("capped")))
        found = met if found is None else found.unionByName(met)
        new = met.where("NOT exit").groupBy("start", F.col("neighbor").alias("node")).agg(F.min("key").alias("key")).join(seen, ["start", "node"], "left_anti")
        front = cut(new)
        if front.isEmpty():
            break
        seen = seen.unionByName(front.select("start", "node"))
    else:
        cuts = front.join(step.select(F.col("at").alias("node")).distinct(), "node", "left_semi").select("start").distinct()
    over = found.groupBy("start").agg(F.bool_or("capped").alias("truncated"))
    if cuts is not None:
        over = over.join(cuts.withColumn("deep", F.lit(True)), "start", "left").select("start", (F.col("truncated") | F.col("deep").isNotNull()).alias("truncated"))
    return found.drop("capped"), over


def resolve_exits(edges: DataFrame, exits: DataFrame, floor: float = 0.3) -> DataFrame:
    """start, channel, next_ids: where the channels a segment produced to lead on, sorted and distinct.

    ``exits`` has start, producer, channel. The hand-off must start at the producer and pass this channel.
    """
    onward = edges.where((F.col("type") == "NEXT_SEGMENT") & above(floor)).select(F.col("src").alias("producer"), F.col("via_channel").alias("channel"), F.col("dst").alias("next"))
    met = exits.select("start", "producer", "channel").distinct().join(onward, ["producer", "channel"], "left")
    return met.groupBy("start", "channel").agg(F.array_sort(F.collect_set("next")).alias("next_ids"))


def compact(steps: DataFrame, protected: Column, gate: int = 15, run: int = 6, head: int = 3, tail: int = 2) -> DataFrame:
    """Steps (start, nth, ...) with long unprotected runs cut to a head, a ``collapsed`` row and a tail; only where a segment has more than ``gate`` steps."""
    w = Window.partitionBy("start")
    marked = steps.withColumns({"__p": protected, "__n": F.count(F.lit(1)).over(w)})
    marked = marked.withColumn("__island", F.sum(F.col("__p").cast("int")).over(w.orderBy("nth")))
    island = Window.partitionBy("start", "__island", "__p")
    marked = marked.withColumns({"__k": F.row_number().over(island.orderBy("nth")), "__len": F.count(F.lit(1)).over(island)})
    long = ~F.col("__p") & (F.col("__n") > gate) & (F.col("__len") > run)
    kept = ~long | (F.col("__k") <= head) | (F.col("__k") > F.col("__len") - tail)
    marker = long & (F.col("__k") == head + 1)
    return marked.where(kept | marker).withColumn("collapsed", F.when(marker, F.col("__len") - (head + tail))).drop("__p", "__n", "__island", "__k", "__len")


def climb(edges: DataFrame, starts: DataFrame, stop: DataFrame) -> DataFrame:
    """start, top: follow each node's least predecessor until one in ``stop``, one without predecessor, or a repeat.

    Parents are one per node, so a level is an equi-join of as many rows as there are starts; a chain
    is followed however long it is. Parents of nodes where a walk may go on are written once.
    """
    parent = edges.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
    way = cut(parent.join(stop.select(F.col("id").alias("node")), "node", "left_anti"))
    now = starts.select(F.col("id").alias("start"), F.col("id").alias("node"), F.array("id").alias("trail")).distinct()
    done = None
    while True:
        met = now.join(way, "node", "left")
        ends = F.col("parent").isNull() | F.array_contains("trail", F.col("parent"))
        met = cut(met.select("start", "node", "trail", "parent", ends.alias("ends")))
        part = met.where("ends").select("start", F.col("node").alias("top"))
        done = part if done is None else done.unionByName(part)
        now = met.where("NOT ends").select("start", F.col("parent").alias("node"), F.array_append("trail", F.col("parent")).alias("trail"))
        if now.isEmpty():
            return done


def descendants(edges: DataFrame, roots: DataFrame, stop: DataFrame) -> DataFrame:
    """root, node: CONTAINS descendants that are not in ``stop`` and are reached without passing through it (the root itself included)."""
    down = edges.where("type = 'CONTAINS'").select(F.col("src").alias("node"), F.col("dst").alias("child")).join(stop.select(F.col("id").alias("child")), "child", "left_anti")
    front = roots.select(F.col("id").alias("root"), F.col("id").alias("node")).distinct()
    seen = front
    while not front.isEmpty():
        met = front.join(down, "node").select("root", F.col("child").alias("node")).distinct()
        front = cut(met.join(seen, ["root", "node"], "left_anti"))
        seen = seen.unionByName(front)
    return seen
