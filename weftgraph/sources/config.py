"""Workspace configuration: services, idioms, processes and environment files.

A workspace is a YAML or JSON file, or a directory, which stands for one service of its own name.
Unknown fields, missing paths and rules that say too little or too much are errors.
"""

from __future__ import annotations

import json
import os
import re
from dataclasses import dataclass, fields
from pathlib import Path

from weftgraph.operators.extract import Consumer, HttpClient, Idioms, Producer, RouteFrom, Topic, VerbFrom


class ConfigError(Exception):
    """The configuration cannot be used."""


@dataclass(frozen=True)
class Service:
    name: str
    path: str
    exclude: tuple[str, ...] = ()
    base_url_envs: tuple[str, ...] = ()
    symbol_index: str | None = None


@dataclass(frozen=True)
class Process:
    name: str
    entrypoint: str


@dataclass(frozen=True)
class Workspace:
    graph_name: str
    services: tuple[Service, ...]
    idioms: Idioms = Idioms()
    processes: tuple[Process, ...] = ()
    env_sources: tuple[str, ...] = ()


def parse_text(path: str, text: str):
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ConfigError("YAML needs the yaml package; JSON does not") from e
    try:
        return yaml.safe_load(text)
    except yaml.YAMLError as e:
        raise ConfigError(f"{path}: {e}") from e


def checked(kind, given: dict, where: str):
    """An instance of a dataclass from a mapping, with lists as tuples and nothing unknown."""
    if not isinstance(given, dict):
        raise ConfigError(f"{where}: a mapping is wanted")
    known = {f.name for f in fields(kind)}
    if unknown := set(given) - known:
        raise ConfigError(f"{where}: unknown {', '.join(sorted(unknown))}")
    try:
        return kind(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})
    except TypeError as e:
        raise ConfigError(f"{where}: {e}") from e


def nested(given: dict, where: str) -> dict:
    """A rule's mapping with its inner mappings checked."""
    inner = {"route_from": RouteFrom, "verb_from": VerbFrom, "topic": Topic}
    if not isinstance(given, dict):
        raise ConfigError(f"{where}: a mapping is wanted")
    return {k: checked(inner[k], v, f"{where}.{k}") if k in inner and v is not None else v for k, v in given.items()}


def checked_idioms(given: dict) -> Idioms:
    own = {"producers": Producer, "consumers": Consumer, "clients": HttpClient}
    if unknown := set(given) - set(own):
        raise ConfigError(f"idioms: unknown {', '.join(sorted(unknown))}")
    built = Idioms()
    merged = {}
    for name, kind in own.items():
        rules = tuple(checked(kind, nested(r, f"idioms.{name}"), f"idioms.{name}") for r in given.get(name, []))
        for r in rules:
            call = getattr(r, "call", getattr(r, "name", "x"))
            if isinstance(r, HttpClient):
                if len({x is None for x in (r.call, r.route_from, r.verb_from)}) > 1:
                    raise ConfigError("idioms.clients: call, route_from and verb_from go together")
                call = f"{r.call}|{r.verb_from.request_ctor}" if r.call is not None else "x"
            if any(not part for part in call.split("|")):
                raise ConfigError(f"idioms.{name}: an empty alternative in {call!r}")
            topic = getattr(r, "topic", None)
            named = [f.name for f in fields(Topic) if topic is not None and getattr(topic, f.name) is not None]
            if topic is not None and len(named) != 1:
                raise ConfigError(f"idioms.{name}: a topic is named in one way")
            if topic is not None and (named[0] in ("attr", "settings")) < (getattr(r, "form", "") == "base_class"):
                raise ConfigError("idioms.consumers: a base class has no call that names a topic")
            if isinstance(r, Consumer) and r.form not in ("call", "dispatch_dict", "base_class"):
                raise ConfigError(f"idioms.consumers: unknown form {r.form}")
        merged[name] = rules + getattr(built, name)  # a workspace's own rules come first
    return Idioms(**merged)


def load_workspace(target: str) -> Workspace:
    at = Path(target)
    if at.is_dir():
        return Workspace(at.name, (Service(re.sub(r"[^A-Za-z0-9_-]", "-", at.name), str(at)),))
    if not at.is_file():
        raise ConfigError(f"no such file: {target}")
    given = parse_text(str(at), at.read_text()) or {}
    if unknown := set(given) - {"version", "graph_name", "services", "idioms", "processes", "env_sources"}:
        raise ConfigError(f"unknown {', '.join(sorted(unknown))}")
    services = []
    for raw in given.get("services", []):
        s = checked(Service, raw, "services")
        if not re.fullmatch(r"[A-Za-z0-9_-]+", s.name):
            raise ConfigError(f"services: bad name {s.name!r}")
        path = s.path if "://" in s.path else os.path.normpath(at.parent / s.path)
        if "://" not in path and not os.path.isdir(path):
            raise ConfigError(f"services: no such directory: {path}")
        found = s.symbol_index
        if found and "://" not in found:
            found = os.path.normpath(at.parent / found)
            if not os.path.isfile(found):
                raise ConfigError(f"services: no such symbol index: {found}")
        services.append(Service(s.name, path, s.exclude, s.base_url_envs, found))
    if not services or len({s.name for s in services}) < len(services):
        raise ConfigError("services: at least one is wanted, each by a name of its own")
    envs = [str(at.parent / e) for e in given.get("env_sources", [])]
    if missing := [e for e in envs if not os.path.isfile(e)]:
        raise ConfigError(f"env_sources: no such file: {missing[0]}")
    processes = tuple(checked(Process, p, "processes") for p in given.get("processes", []))
    return Workspace(given.get("graph_name", at.stem), tuple(services), checked_idioms(given.get("idioms", {})), processes, tuple(envs))


def walk_strings(node) -> list[tuple[str, str]]:
    """Every nested (key, string) pair, in order."""
    if isinstance(node, dict):
        return [p for k, v in node.items() for p in ([(str(k), v)] if isinstance(v, str) else walk_strings(v))]
    if isinstance(node, list):
        pairs = []
        for x in node:
            if isinstance(x, dict) and isinstance(x.get("name"), str) and isinstance(x.get("value"), str):
                pairs.append((x["name"], x["value"]))
            else:
                pairs += walk_strings(x)
        return pairs
    return []


def env_pairs(paths: tuple[str, ...], warn=print) -> dict[str, str]:
    """Name to value over all files; later ones win; a file that does not parse is passed over with a warning."""
    out: dict[str, str] = {}
    for path in paths:
        try:
            out |= dict(walk_strings(parse_text(path, Path(path).read_text())))
        except (ConfigError, ValueError) as e:
            warn(f"{path} is passed over: {e}")
    return out


def env_maps(pairs: dict[str, str], services: tuple[Service, ...]) -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """(registry, services, hosts) by environment name: declared ones, hosts whose first label is a service, and all hosts."""
    registry = {env: s.name for s in services for env in s.base_url_envs}
    hosts = {}
    for name, v in pairs.items():
        if m := re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", v):
            hosts[name] = m[1].lower()
    names = {s.name for s in services}
    return registry, {k: h.split(".")[0] for k, h in hosts.items() if h.split(".")[0] in names}, hosts
