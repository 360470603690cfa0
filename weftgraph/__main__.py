"""python -m weftgraph init FOLDER | index WORKSPACE OUT | stats OUT | trace OUT SELECTOR [--mermaid] | search OUT QUERY | eval OUT QUESTIONS | doctor WORKSPACE"""

from __future__ import annotations

import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from weftgraph.api import Api
from weftgraph.operators import processes, trace
from weftgraph.operators.report import summary
from weftgraph.plans import analyze, golden, snapshot
from weftgraph.session import local_session
from weftgraph.sources import config

TABLES = ("files", "nodes", "edges", "processes", "members", "chunks")


def index(spark: SparkSession, workspace: str, out: str) -> dict:
    """Analyse a workspace and publish each table; returns the report, which is also written."""
    w = config.load_workspace(workspace)
    services = {s.name: s.path for s in w.services}
    lost = 0
    graph = analyze.index(spark, services, w.idioms, config.env_maps(config.env_pairs(w.env_sources), w.services), indexes={s.name: s.symbol_index for s in w.services if s.symbol_index}, excludes={s.name: s.exclude for s in w.services})
    if w.processes:
        declared = spark.createDataFrame([(p.name, p.entrypoint) for p in w.processes], "name string, selector string")
        resolved = processes.resolve(declared, graph.nodes, graph.edges)
        lost = resolved.where("entry IS NULL").count()
        resolved = resolved.where("entry IS NOT NULL")
        flows = resolved.select(F.concat(F.lit("proc:"), F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-")).alias("process"), "name", "entry", F.lit("config").alias("source"))
        graph.processes = flows.unionByName(graph.processes.join(flows.select("process"), "process", "left_anti"))
    made = graph.chunks.select(F.col("chunk_id").alias("id"), F.col("symbol_id").alias("symbol"), "chunk_kind", "service", "relpath", "text", "start_line", "end_line", "context_header", "input_hash", F.lit(None).cast("array<float>").alias("vector"))
    for name in TABLES:
        snapshot.publish(made if name == "chunks" else getattr(graph, name), f"{out}/{name}")
    report = summary(graph.nodes, graph.edges) | {"processes_unresolved": lost}
    spark.createDataFrame([(json.dumps(report, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/report")
    return report


def open_api(spark: SparkSession, out: str) -> Api:
    """Tools over the newest published tables; the pointer is read on each call."""
    t = {name: snapshot.read_current(spark, f"{out}/{name}") for name in TABLES}
    if t["nodes"] is None:
        raise SystemExit(f"no graph in {out}")
    return Api(t["nodes"], t["edges"], t["files"], t["processes"], t["chunks"])


def init(folder: str) -> str:
    """Write a workspace of the folder itself to start from; one that is there stays."""
    at = Path(folder) / "weftgraph.json"
    body = {"version": 1, "graph_name": Path(folder).resolve().name, "services": [{"name": "main", "path": ".", "exclude": [], "base_url_envs": []}], "idioms": {"producers": [], "consumers": [], "clients": []}, "processes": [], "env_sources": []}
    with open(at, "x") as f:
        json.dump(body, f, indent=2)
    return str(at)


def doctor(spark: SparkSession, workspace: str) -> list[str]:
    """What is wrong with a workspace, in words; nothing if all is well."""
    try:
        w = config.load_workspace(workspace)
    except config.ConfigError as e:
        return [str(e)]
    return [f"{s.name}: no Python file" for s in w.services if analyze.scan(spark, {s.name: s.path}).isEmpty()]


def main(args: list[str]) -> int:
    if not args or args[0] not in ("init", "index", "stats", "trace", "search", "eval", "doctor"):
        print(__doc__)
        return 2
    if args[0] == "init":
        try:
            print(f"written: {init(args[1] if len(args) > 1 else '.')}")
        except FileExistsError as e:
            print(f"is there already: {e.filename}")
            return 1
        return 0
    spark = SparkSession.getActiveSession() or local_session()
    if args[0] == "index":
        print(json.dumps(index(spark, args[1], args[2]), indent=1, sort_keys=True))
    elif args[0] == "doctor":
        problems = doctor(spark, args[1])
        print("\n".join(problems) or "all is well")
        return int(bool(problems))
    else:
        api = open_api(spark, args[1])
        if args[0] == "stats":
            print(json.dumps(api.graph_stats(), indent=1, sort_keys=True))
        elif args[0] == "trace":
            found = api.trace_process(args[2])
            print(found["error"] if "error" in found else trace.mermaid(found) if "--mermaid" in args else trace.tree(found))
            return int("error" in found)
        elif args[0] == "eval":
            rows = golden.retrieval(api, golden.golden_questions(args[2]))
            for r in rows:
                print(f"{'hit' if r['hit'] else 'miss'}\t{'-' if r['rank'] is None else r['rank']}\t{r['question']}")
            print(f"{sum(r['hit'] for r in rows)} of {len(rows)}")
        else:
            print(json.dumps(api.search_code(args[2]), indent=1, sort_keys=True, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
