"""Deferred facts ("claims"): typed tables, one per kind, read from JSON payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Payload fields by kind.
KINDS = {
    "http_call": "src_id string, verb string, path_template string, base_url_env string, resolution_hint string, evidence_line int",
    "route_decl": "router_symbol string, verb string, path string, handler_node_id string, prefix_local string, evidence_line int",
    "router_include": "parent_symbol string, child_symbol string, prefix string",
    "router_decl": "router_symbol string, prefix_local string",
    "temporal_start_mark": "src_id string, dst_id string, evidence_line int",
    "temporal_signal_send": "src_id string, method_symbol string, evidence_line int",
    "class_attrs": "class_fqn string, fields map<string,struct<`default`:string,env_name:string>>, enum_values array<string>",
    "module_singletons": "name string, class_symbol string, class_name_text string, resolution_tier string, relpath string",
}


def parsed(claims: DataFrame, schema: str) -> DataFrame:
    """Payload fields as columns, with ``_service`` and ``_relpath``; a malformed payload gives nulls."""
    rest = [c for c in claims.columns if c not in ("payload", "service", "relpath")]
    return claims.select(*rest, F.col("service").alias("_service"), F.col("relpath").alias("_relpath"), F.from_json("payload", schema).alias("p")).select(*rest, "_service", "_relpath", "p.*")


def of_kind(claims: DataFrame, kind: str) -> DataFrame:
    return parsed(claims.where(F.col("kind") == kind).drop("kind"), KINDS[kind])
