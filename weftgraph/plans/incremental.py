"""Incremental runs: an incremental result equals a full rebuild.

Parsing is the costly step and depends on one file alone, so facts are kept by file: facts of
changed, added and deleted files leave, changed and added files are parsed again. Everything after
parsing is joins over the facts and runs on all of them, which makes the law hold by construction.
A changed configuration, or none known, makes a full run; nothing changed makes no run at all.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import extract, staging
from weftgraph.plans.analyze import Graph, build, references, scan
from weftgraph.schema import SCHEMA_VERSION
from weftgraph.session import cut
from weftgraph.sources.pyfacts import parse

KEYS = ["service", "relpath"]


@dataclass
class State:
    fingerprint: str
    files: DataFrame
    parsed: DataFrame


def fingerprint(idioms: extract.Idioms, excludes: tuple[str, ...] = ()) -> str:
    """SHA-256 of the canonical JSON of all that the facts and rules depend on besides the files."""
    body = {"excludes": sorted(excludes), "idioms": asdict(idioms), "schema": SCHEMA_VERSION}
    return hashlib.sha256(json.dumps(body, sort_keys=True, default=list).encode()).hexdigest()


def refresh(spark: SparkSession, services: dict[str, str], before: State | None, idioms: extract.Idioms | None = None, excludes: tuple[str, ...] = ()) -> tuple[State, str]:
    """(state, mode): mode is full, incremental or skipped."""
    idioms = idioms or extract.Idioms()
    now = fingerprint(idioms, excludes)
    files = cut(scan(spark, services, excludes))
    if before is None or before.fingerprint != now:
        return State(now, files, cut(parse(files))), "full"
    changes = cut(staging.delta(before.files, files, KEYS, "sha256"))
    if changes.where("status != 'unchanged'").isEmpty():
        return before, "skipped"
    gone = changes.where("status IN ('changed', 'deleted')")
    stale = changes.where("status IN ('added', 'changed')").select(*KEYS)
    kept = staging.delete_file_layer(before.parsed, gone, {"service": "service", "relpath": "relpath"})
    fresh = parse(files.join(stale, KEYS, "left_semi"))
    return State(now, files, cut(kept.unionByName(fresh))), "incremental"


def rebuild(state: State, idioms: extract.Idioms | None = None, indexes: dict[str, str] | None = None) -> Graph:
    """The graph of a state; ``indexes`` maps a service to its symbol index, which is read anew."""
    return build(state.files, state.parsed, idioms, refs=references(state.files, indexes or {}))


def dump(graph: Graph) -> dict[str, list]:
    """A graph as sorted rows, to compare two of them column by column."""
    rows = lambda df: sorted(map(repr, df.select(*sorted(df.columns)).collect()))
    return {"nodes": rows(graph.nodes.drop("props")), "edges": rows(graph.edges), "processes": rows(graph.processes), "members": rows(graph.members)}


def live_vectors(chunks: DataFrame) -> bool:
    return not chunks.where(F.col("embedding").isNotNull()).isEmpty()
