"""The nine read-only tools over a graph. Failures are ``{"error": ...}`` and never exceptions of the tool's own."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators import graph, search, trace
from weftgraph.schema import HTTP_VERBS


class Api:
    """``nodes`` and ``edges`` as the analysis gives them; ``files`` for sources, ``processes``, ``chunks`` for search."""

    def __init__(self, nodes: DataFrame, edges: DataFrame, files: DataFrame | None = None, processes: DataFrame | None = None, chunks: DataFrame | None = None, embed=None) -> None:
        self.nodes, self.edges, self.files, self.processes, self.chunks, self.embed = nodes, edges, files, processes, chunks, embed
        self.spark = nodes.sparkSession

    def start(self, node_id: str) -> DataFrame:
        return self.spark.createDataFrame([(node_id,)], "id string")

    def named(self, ids: set[str]) -> list[dict]:
        """Known nodes among ``ids``, by id."""
        rows = self.nodes.where(F.col("id").isin(sorted(ids))).select("id", "kind", "service", "name", "roles").collect() if ids else []
        return sorted((r.asDict() for r in rows), key=lambda r: r["id"])

    def graph_stats(self) -> dict:
        count = lambda df, c: {r[c]: r["count"] for r in df.groupBy(c).count().collect()}  # noqa: E731  a row for each kind
        return {"nodes": count(self.nodes, "kind"), "edges": count(self.edges, "type")}

    def get_source(self, node_id: str, context_lines: int = 0) -> dict:
        node = self.nodes.where(F.col("id") == node_id).first()
        if node is None or self.files is None or not node.relpath:
            return {"error": f"no source for {node_id}"}
        file = self.files.where((F.col("service") == node.service) & (F.col("relpath") == node.relpath)).first()
        if file is None or node.relpath.startswith("/") or ".." in node.relpath.split("/"):
            return {"error": f"no file for {node_id}"}
        lines = bytes(file.content).decode("utf-8", "replace").splitlines()
        first, last = max(1, node.start_line - context_lines), min(len(lines), max(node.end_line, node.start_line) + context_lines)
        body = bytes(file.content)[node.start_byte : node.end_byte]
        stale = "content_hash" in node and node.content_hash is not None and hashlib.sha256(body).hexdigest() != node.content_hash
        return {"source": "\n".join(lines[first - 1 : last]), "file": node.relpath, "start_line": first, "end_line": last, "stale": stale}

    def expand_neighbors(self, node_id: str, edge_types: list[str] | None = None, direction: str = "both", depth: int = 1, limit: int = 50) -> dict:
        if direction not in ("out", "in", "both"):
            return {"error": f"direction must be out, in or both: {direction}"}
        hops, over = graph.expand(self.edges, self.start(node_id), edge_types, direction, depth, limit)
        rows = hops.orderBy("level", "at", F.col("direction") == "in", "edge_type", "neighbor").collect()  # at most ``limit``
        cut = over.first()
        return {"nodes": self.named({r.neighbor for r in rows}), "hops": [{"node": r["at"], "edge_type": r.edge_type, "neighbor": r.neighbor, "direction": r.direction, "edge_props": {c: r[c] for c in ("confidence", "resolution") if c in hops.columns}} for r in rows], "truncated": bool(cut and cut.truncated)}

    def who_calls(self, node_id: str, transitive: bool = False, max_depth: int = 3) -> dict:
        rows = graph.who_calls(self.edges, self.nodes, self.start(node_id), transitive, max_depth, 51).orderBy("level", "node").collect()
        shown = {r["id"]: r for r in self.named({r.node for r in rows[:50]})}
        callers = [shown.get(r.node, {"id": r.node}) | ({"mechanism": "invokes_activity"} if r.via_activity else {}) for r in rows[:50]]
        return {"callers": callers, "truncated": len(rows) > 50}

    def trace_process(self, entrypoint_id: str, direction: str = "downstream", max_segments: int = 12, min_confidence: float = 0.3, include_source: bool = False, compact: bool = True) -> dict:
        if direction != "downstream":
            return {"error": "only downstream traces are supported"}
        entry = entrypoint_id if ":`" in entrypoint_id or self.nodes.where(F.col("id") == entrypoint_id).count() else self.resolve_selector(entrypoint_id)
        if entry is None:
            return {"error": f"cannot resolve {entrypoint_id}"}
        out = trace.trace_process(self.edges, self.nodes, entry, max_segments, min_confidence, compact)
        if include_source:
            for s in out["segments"]:
                s["source"] = self.get_source(s["entry"]).get("source")
        return out

    def resolve_selector(self, selector: str) -> str | None:
        """``service:METHOD /path`` or ``service:qualified.name``: the lowest id that fits."""
        service, _, rest = selector.partition(":")
        verb, _, path = rest.partition(" ")
        if path and verb.upper() in HTTP_VERBS:
            row = self.edges.where((F.col("type") == "HANDLES") & (F.col("src") == f"chan:http:{service}:{verb.upper()} {path.strip()}")).agg(F.min("dst")).first()
        else:
            row = self.nodes.where((F.col("service") == service) & (F.col("qualified_name") == rest) & F.col("kind").isin("Module", "Class", "Function")).agg(F.min("id")).first()
        return row[0]

    def find_paths(self, from_id: str, to_id: str, max_hops: int = 8, edge_types: list[str] | None = None) -> dict:
        pairs = self.spark.createDataFrame([(from_id, to_id)], "start string, goal string")
        row = graph.shortest_paths(self.edges, pairs, edge_types, max_hops).first()
        if row is None or row.path is None:
            return {"path": None}
        return {"path": [{"node": from_id}, *({"node": h.node, "edge_type": h.edge_type, "direction": h.direction} for h in row.path)]}

    def list_processes(self) -> dict:
        rows = self.processes.orderBy("process").collect() if self.processes is not None else []
        return {"processes": [{"id": r.process, "name": r.name, "entrypoint_id": r.entry, "source": r.source} for r in rows]}

    def find_entrypoint(self, query: str, kinds: list[str] | None = None, k: int = 5) -> dict:
        symbols = self.nodes.where(F.col("kind").isin("Module", "Class", "Function"))
        posted = search.postings(symbols, "id", F.concat_ws(" ", F.regexp_replace("name", "_", " "), "name", F.translate("qualified_name", "._", "  ")))
        found = search.find_entrypoint(posted, self.chunks, self.question(query), symbols, kinds, k).orderBy(F.desc("score"), "id").collect()
        shown = {r["id"]: r for r in self.named({r.id for r in found})}
        return {"results": [shown[r.id] | {"score": r.score} for r in found if r.id in shown], "mode_used": "hybrid" if self.embed else "text"}

    def question(self, query: str) -> DataFrame:
        vector = list(map(float, self.embed(query))) if self.embed else None
        return self.spark.createDataFrame([(0, query, vector)], "question int, text string, vector array<double>")

    def search_code(self, query: str, k: int = 8, service: str | None = None, mode: str = "hybrid") -> dict:
        if mode not in ("text", "vector", "hybrid"):
            return {"error": f"unknown mode: {mode}"}
        if self.chunks is None or (mode == "vector" and self.embed is None):
            return {"error": "no vectors to search by" if self.chunks is not None else "nothing to search"}
        used = mode if self.embed else "text"
        posted = search.postings(self.chunks, "id", F.col("text"))
        found = search.items(search.search_code(self.chunks, posted, self.question(query), k, used, service), self.chunks).orderBy("rank").collect()
        return {"results": [{c: v for c, v in r.asDict().items() if c != "question"} for r in found], "mode_used": used}
