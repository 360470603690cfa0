"""Traces across services: segments joined by hand-offs, for one entry point at a time.

A trace is an interactive answer of at most 20 segments of bounded size. Each level of a segment is
one lookup of the frontier in the edges; what comes back is at most eight hops a node.
"""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import graph
from weftgraph.schema import EXIT_TYPES, STEP_TYPES

MAX_SEGMENTS = 20


def walk(edges: DataFrame, entry: str, floor: float) -> dict:
    """steps (src, type, dst, confidence) in breadth-first order, exits by channel, truncated."""
    for name, kind in (("external", "boolean"), ("external_host", "string")):
        edges = edges if name in edges.columns else edges.withColumn(name, F.lit(None).cast(kind))
    wanted = edges.where(F.col("type").isin(*STEP_TYPES, *EXIT_TYPES) & graph.above(floor))
    seen, front, steps, exits, truncated = {entry}, [entry], [], [], False
    for depth in range(graph.SEGMENT_DEPTH + 1):
        if not front:
            break
        rows = wanted.where(F.col("src").isin(front)).select("src", "type", "dst", "confidence", "external", "external_host").distinct()
        onward: dict[str, list] = {}
        for r in rows.collect():  # the hops of one level of one segment
            onward.setdefault(r.src, []).append(r)
        if depth == graph.SEGMENT_DEPTH:
            truncated = truncated or bool(onward)
            break
        after = []
        for node in front:
            hops = sorted(onward.get(node, []), key=lambda r: (r.type, r.dst))
            truncated = truncated or len(hops) > graph.BRANCHES
            for r in hops[: graph.BRANCHES]:
                if r.type in EXIT_TYPES:
                    exits.append(r)
                    continue
                steps.append(r)
                if r.dst not in seen:
                    seen.add(r.dst)
                    after.append(r.dst)
        front = after
    return {"steps": steps, "exits": exits, "truncated": truncated}


def compact_steps(steps: list, protected: set[str]) -> list[dict]:
    """Long runs of steps to unprotected nodes keep three, a count and two; only past fifteen steps."""
    shown = [{"edge_type": r.type, "node": r.dst, "confidence": r.confidence} for r in steps]
    if len(shown) <= 15:
        return shown
    out, run = [], []

    def flush():
        out.extend(run if len(run) <= 6 else [*run[:3], {"collapsed": len(run) - 5}, *run[-2:]])
        run.clear()

    for step in shown:
        if step["node"] in protected:
            flush()
            out.append(step)
        else:
            run.append(step)
    flush()
    return out


def trace_process(edges: DataFrame, nodes: DataFrame, entry: str, max_segments: int = 12, floor: float = 0.3, compact: bool = True) -> dict:
    """segments, confidence, truncated, external_exit_count."""
    max_segments = max(1, min(MAX_SEGMENTS, max_segments))
    queue, queued, segments, least, truncated, external = deque([entry]), {entry}, [], 1.0, False, 0
    while queue and len(segments) < max_segments:
        at = queue.popleft()
        node = nodes.where(F.col("id") == at).first()
        if node is None:
            continue
        walked = walk(edges, at, floor)
        channels = sorted({r.dst for r in walked["exits"]})
        makers = sorted({r.src for r in walked["exits"]})
        onward = edges.where((F.col("type") == "NEXT_SEGMENT") & F.col("src").isin(makers) & F.col("via_channel").isin(channels) & graph.above(floor)).select("src", "via_channel", "dst").distinct().collect() if channels else []
        made = {(r.src, r.dst) for r in walked["exits"]}
        exits = []
        for channel in channels:
            nexts = sorted({r.dst for r in onward if r.via_channel == channel and (r.src, channel) in made})
            hosts = {r.external_host for r in walked["exits"] if r.dst == channel and r.external}
            exits.append({"channel": channel, "next_entry_ids": nexts, "external": bool(hosts), **({"external_host": min(hosts)} if hosts else {})})
            external += bool(hosts)
            for n in nexts:
                if n not in queued:
                    queued.add(n)
                    queue.append(n)
        walked_confidences = [r.confidence for r in walked["steps"]] + [r.confidence for r in walked["exits"] if not r.external]
        least = min([least, *(c for c in walked_confidences if c is not None)])
        steps = walked["steps"]
        if compact and len(steps) > 15:
            names = sorted({r.dst for r in steps})
            roles = {r.id for r in nodes.where(F.col("id").isin(names) & (F.size("roles") > 0)).select("id").collect()}
            many = {s for s in names if sum(r.src == s for r in steps) > 1}
            steps = compact_steps(steps, roles | many | set(makers))
        else:
            steps = [{"edge_type": r.type, "node": r.dst, "confidence": r.confidence} for r in steps]
        truncated = truncated or walked["truncated"]
        segments.append({"service": node.service, "entry": at, "steps": steps, "exits": exits, "truncated": walked["truncated"]})
    return {"segments": segments, "confidence": least, "truncated": truncated or bool(queue), "external_exit_count": external}


def tree(trace: dict) -> str:
    """A trace as indented text."""
    out = []
    for k, s in enumerate(trace["segments"], 1):
        out.append(f"{k}. [{s['service']}] {s['entry']}")
        out += [f"   … {x['collapsed']} more" if "collapsed" in x else f"   {x['edge_type']} {x['node']}" for x in s["steps"]]
        out += [f"   → {e['channel']} → {', '.join(e['next_entry_ids']) or '(nobody)'}" for e in s["exits"]]
    return "\n".join([*out, f"confidence {trace['confidence']:g}" + (", truncated" if trace["truncated"] else "")])


def mermaid(trace: dict) -> str:
    """A trace as a Mermaid flow chart."""
    number: dict[str, str] = {}
    name = lambda x: number.setdefault(x, f"n{len(number)}")
    out = ["flowchart TD"]
    for s in trace["segments"]:
        out.append(f'  {name(s["entry"])}["{s["entry"]}"]')
        for e in s["exits"]:
            out += [f'  {name(s["entry"])} -->|"{e["channel"]}"| {name(n)}' for n in e["next_entry_ids"]]
    return "\n".join(out)
