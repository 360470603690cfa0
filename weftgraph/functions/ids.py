"""Identifiers: module names, symbols, channels and processes, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftgraph.functions.scalars import SEPARATORS, SPACES


def relpath_to_module(relpath: Column) -> Column:
    """``a/b/__init__.py`` and ``a/b.py`` both give ``a.b``."""
    return F.translate(F.regexp_replace(F.regexp_replace(relpath, r"\.py$", ""), r"/__init__$", ""), "/", ".")


def containing_package(relpath: Column) -> Column:
    """The package a file lies in: itself for ``__init__.py``, else its parent; empty at the top."""
    module = relpath_to_module(relpath)
    parent = F.when(F.contains(module, F.lit(".")), F.regexp_replace(module, r"\.[^.]*$", "")).otherwise("")
    return F.when(relpath.rlike(r"(^|/)__init__\.py$"), module).otherwise(parent)


def resolve_relative_import(package: Column, dots: Column, target: Column) -> Column:
    """``n`` dots climb ``n - 1`` packages; climbing past the top leaves an empty base."""
    parts = F.when(package == "", F.array().cast("array<string>")).otherwise(F.split(package, r"\."))
    kept = F.greatest(F.size(parts) - (dots - 1), F.lit(0))
    base = F.array_join(F.slice(parts, F.lit(1), kept), ".")
    return F.when(dots == 0, target).when(base == "", target).when(target == "", base).otherwise(F.concat_ws(".", base, target))


def module_descriptor(module: Column) -> Column:
    return F.concat(F.lit("`"), module, F.lit("`/"))


def structural_descriptor(module: Column, classes: Column, function: Column) -> Column:
    """Module, then ``Name#`` per enclosing class, then ``name().`` if a function is named."""
    nested = F.aggregate(classes, F.lit(""), lambda acc, c: F.concat(acc, c, F.lit("#")))
    return F.concat(module_descriptor(module), nested, F.when(function.isNull(), "").otherwise(F.concat(function, F.lit("()."))))


def display_name(descriptor: Column) -> Column:
    """Dotted name of a descriptor."""
    dotted = F.replace(F.replace(F.replace(F.replace(descriptor, F.lit("`/"), F.lit(".")), F.lit("`"), F.lit("")), F.lit("()."), F.lit(".")), F.lit("#"), F.lit("."))
    return F.regexp_replace(dotted, r"\.+$", "")


def symbol_id(service: Column, descriptors: Column) -> Column:
    return F.concat(F.lit("sym:"), service, F.lit(":"), descriptors)


def local_symbol_id(service: Column, relpath: Column, local: Column) -> Column:
    return F.concat(F.lit("sym:"), service, F.lit(":"), relpath, F.lit(":"), F.replace(local, F.lit(" "), F.lit("")))


def service_of(node_id: Column) -> Column:
    """The service in a ``sym:`` or ``svc:`` id, else null."""
    return F.when(F.startswith(node_id, F.lit("sym:")), F.split_part(node_id, F.lit(":"), F.lit(2))).when(F.startswith(node_id, F.lit("svc:")), F.substring(node_id, 5, 1_000_000))


def channel_id(kind: str, name: Column) -> Column:
    return F.concat(F.lit(f"chan:{kind}:"), name)


def route_id(owner: Column, method: Column, template: Column) -> Column:
    return F.concat(F.lit("chan:http:"), F.coalesce(owner, F.lit("?")), F.lit(":"), method, F.lit(" "), template)


def process_id(name: Column) -> Column:
    return F.concat(F.lit("proc:"), slugify(name))


def slugify(text: Column) -> Column:
    s = F.regexp_replace(F.lower(F.btrim(text, F.lit(SEPARATORS))), SPACES, "-")
    s = F.regexp_replace(F.regexp_replace(s, "[^a-z0-9-]", ""), "-+", "-")
    return F.regexp_replace(s, "^-|-$", "")


def symbol_parts(symbol: Column) -> Column:
    """``scheme manager package version descriptors``; ``local N`` has no parts; fewer than five is null."""
    parts = F.split(symbol, " ", 5)
    return F.when(~F.startswith(symbol, F.lit("local ")) & (F.size(parts) == 5), parts)


def node_of_symbol(service: Column, relpath: Column, symbol: Column) -> Column:
    """The node id of an index's symbol: by its descriptors, or by its file if it is local; null if it is neither."""
    return F.when(F.startswith(symbol, F.lit("local ")), local_symbol_id(service, relpath, symbol)).otherwise(symbol_id(service, F.get(symbol_parts(symbol), F.lit(4))))


def numbered(base: Column, nth: Column) -> Column:
    """The first definition of an id keeps it; the n-th gets ``~n``."""
    return F.when(nth == 1, base).otherwise(F.concat(base, F.lit("~"), nth.cast("string")))
