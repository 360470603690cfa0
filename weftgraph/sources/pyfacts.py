"""Facts of Python files: definitions, calls, imports, assignments and class attributes.

One parse per file, in Arrow batches; each fact is a row with its kind and a JSON payload, which
``facts`` turns into one typed table per kind. All spans are in UTF-8 bytes. Symbols are joined to
facts afterwards, by position, and never here. A file that does not parse gives one ``error`` row.
"""

from __future__ import annotations

import ast
import json

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VALUE = "struct<kind:string,text:string,name:string,items:array<struct<key:string,value:string>>>"
SCHEMAS = {
    "def": "idx int, parent int, kind string, name string, qualname string, descriptor string, start_byte bigint, end_byte bigint, name_byte bigint, start_line int, end_line int, doc string, signature string, decorators array<string>, bases array<string>, ancestors array<int>",
    "call": f"idx int, encl int, pos bigint, line int, callee string, receiver string, path array<string>, awaited boolean, args array<{VALUE}>, kwargs map<string,{VALUE}>",
    "import": "module string, level int, name string, alias string, pos bigint",
    "assign": "encl int, target string, ctor array<string>, line int, args array<string>, kwargs map<string,string>",
    "self_attr": "encl int, attr string, value string",
    "class_attr": f"cls int, name string, annotation string, value {VALUE}, alias string",
    "const": "name string, value string",
    "decorator": f"def int, path array<string>, args array<{VALUE}>, kwargs map<string,{VALUE}>, line int",
    "error": "message string",
}


def dotted(node: ast.AST) -> list[str]:
    """Names of a dotted path; empty if it is none."""
    if isinstance(node, ast.Name):
        return [node.id]
    if isinstance(node, ast.Attribute):
        base = dotted(node.value)
        return [*base, node.attr] if base else []
    return []


def template(node: ast.JoinedStr) -> str:
    """``<base>`` for an interpolation with nothing before it, ``{last name}`` for others."""
    out = ""
    for part in node.values:
        if isinstance(part, ast.Constant):
            out += str(part.value)
        elif not out:
            out = "<base>"
        else:
            out += "{" + (dotted(part.value) or ["value"])[-1] + "}"
    return out


def value(node: ast.AST | None) -> dict:
    """What an argument is: string, fstring, name, attr, dict or other."""
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        return {"kind": "string", "text": node.value}
    if isinstance(node, ast.JoinedStr):
        return {"kind": "fstring", "text": template(node)}
    if isinstance(node, ast.Name):
        return {"kind": "name", "text": node.id, "name": node.id}
    if isinstance(node, ast.Attribute):
        return {"kind": "attr", "text": ast.unparse(node), "name": node.attr}
    if isinstance(node, ast.Dict):
        items = [{"key": k.value if isinstance(k, ast.Constant) and isinstance(k.value, str) else ast.unparse(k) if k else "**", "value": ast.unparse(v)} for k, v in zip(node.keys, node.values, strict=True)]
        return {"kind": "dict", "text": ast.unparse(node), "items": items}
    return {"kind": "other", "text": ast.unparse(node) if node is not None else ""}


class Walker(ast.NodeVisitor):
    def __init__(self, source: bytes) -> None:
        self.rows: list[tuple[str, dict]] = []
        self.starts = [0]
        for at, byte in enumerate(source):
            if byte == 10:
                self.starts.append(at + 1)
        self.source = source
        self.stack: list[tuple[int, str, str, str]] = []  # idx, kind, qualname, descriptor
        self.defs = self.calls = 0
        self.awaited: set[int] = set()

    def byte(self, line: int, column: int) -> int:
        return self.starts[line - 1] + column

    def add(self, fact: str, /, **payload) -> None:
        self.rows.append((fact, payload))

    @property
    def encl(self) -> int | None:
        return self.stack[-1][0] if self.stack else None

    def define(self, node, kind: str) -> None:
        idx, self.defs = self.defs, self.defs + 1
        start = self.byte(node.lineno, node.col_offset)
        name_byte = self.source.find(node.name.encode(), start)
        qualname = (self.stack[-1][2] + "." if self.stack else "") + node.name
        descriptor = (self.stack[-1][3] if self.stack else "") + node.name + ("#" if kind == "Class" else "().")
        if kind == "Class":
            signature = f"class {node.name}"
        else:
            signature = f"{'async ' if isinstance(node, ast.AsyncFunctionDef) else ''}def {node.name}({ast.unparse(node.args)})"
        self.add(
            "def", idx=idx, parent=self.encl, kind=kind, name=node.name, qualname=qualname, descriptor=descriptor, start_byte=start, end_byte=self.byte(node.end_lineno, node.end_col_offset), name_byte=name_byte,
            start_line=node.lineno, end_line=node.end_lineno, doc=ast.get_docstring(node), signature=signature, decorators=[ast.unparse(d) for d in node.decorator_list],
            bases=[ast.unparse(b) for b in getattr(node, "bases", [])], ancestors=[s[0] for s in self.stack],
        )
        for d in node.decorator_list:
            call = d if isinstance(d, ast.Call) else None
            self.add("decorator", **{"def": idx}, path=dotted(call.func if call else d), args=[value(a) for a in call.args] if call else [], kwargs={k.arg: value(k.value) for k in call.keywords if k.arg} if call else {}, line=d.lineno)
            self.visit(d)
        self.stack.append((idx, kind, qualname, descriptor))
        if kind == "Class":
            for part in node.body:
                self.class_attribute(idx, part)
        else:
            self.visit(node.args)
        for part in node.body:
            self.visit(part)
        self.stack.pop()

    def class_attribute(self, idx: int, part: ast.stmt) -> None:
        alias = None
        if isinstance(part, ast.AnnAssign) and isinstance(part.target, ast.Name):
            v = part.value
            if isinstance(v, ast.Call):
                for k in v.keywords:
                    if k.arg in ("alias", "validation_alias", "env") and isinstance(k.value, ast.Constant):
                        alias = k.value.value
                v = next((k.value for k in v.keywords if k.arg == "default"), v.args[0] if v.args else None)
            self.add("class_attr", cls=idx, name=part.target.id, annotation=ast.unparse(part.annotation), value=value(v), alias=alias)
        elif isinstance(part, ast.Assign) and len(part.targets) == 1 and isinstance(part.targets[0], ast.Name):
            self.add("class_attr", cls=idx, name=part.targets[0].id, annotation=None, value=value(part.value), alias=None)

    def visit_ClassDef(self, node):  # noqa: N802
        self.define(node, "Class")

    def visit_FunctionDef(self, node):  # noqa: N802
        self.define(node, "Function")

    visit_AsyncFunctionDef = visit_FunctionDef  # noqa: N815

    def visit_Await(self, node):  # noqa: N802
        self.awaited.add(id(node.value))
        self.generic_visit(node)

    def visit_Call(self, node):  # noqa: N802
        path = dotted(node.func)
        name = node.func.attr if isinstance(node.func, ast.Attribute) else node.func.id if isinstance(node.func, ast.Name) else ""
        pos = self.byte(node.func.end_lineno, node.func.end_col_offset) - len(name.encode())
        receiver = ast.unparse(node.func.value) if isinstance(node.func, ast.Attribute) else None
        idx, self.calls = self.calls, self.calls + 1
        self.add(
            "call", idx=idx, encl=self.encl, pos=pos, line=node.lineno, callee=name, receiver=receiver, path=path or [*(["?"] if receiver else []), name], awaited=id(node) in self.awaited,
            args=[value(a) for a in node.args], kwargs={k.arg: value(k.value) for k in node.keywords if k.arg},
        )
        self.generic_visit(node)

    def visit_Import(self, node):  # noqa: N802
        for a in node.names:
            self.add("import", module=a.name, level=0, name="", alias=a.asname or a.name.split(".")[0], pos=self.byte(node.lineno, node.col_offset))

    def visit_ImportFrom(self, node):  # noqa: N802
        for a in node.names:
            self.add("import", module=node.module or "", level=node.level, name=a.name, alias=a.asname or a.name, pos=self.byte(node.lineno, node.col_offset))

    def visit_Assign(self, node):  # noqa: N802
        for target in node.targets:
            if isinstance(target, ast.Name):
                if isinstance(node.value, ast.Call) and dotted(node.value.func):
                    c = node.value
                    self.add("assign", encl=self.encl, target=target.id, ctor=dotted(c.func), line=node.lineno, args=[ast.unparse(a) for a in c.args], kwargs={k.arg: value(k.value).get("text", "") for k in c.keywords if k.arg})
                elif not self.stack and isinstance(node.value, ast.Constant) and isinstance(node.value.value, str):
                    self.add("const", name=target.id, value=node.value.value)
            elif isinstance(target, ast.Attribute) and isinstance(target.value, ast.Name) and target.value.id == "self":
                self.add("self_attr", encl=self.encl, attr=target.attr, value=ast.unparse(node.value))
        self.generic_visit(node)


def file_facts(content: bytes) -> list[tuple[str, dict]]:
    try:
        tree = ast.parse(content)
    except (SyntaxError, ValueError) as e:
        return [("error", {"message": str(e)})]
    walker = Walker(content)
    walker.visit(tree)
    doc = ast.get_docstring(tree)
    return [*walker.rows, ("const", {"name": "__doc__", "value": doc})] if doc else walker.rows


def _parse(batches):
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for service, relpath, content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for kind, payload in file_facts(content or b""):
                for column, v in zip(out, (service, relpath, kind, json.dumps(payload)), strict=True):
                    column.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out], names=["service", "relpath", "kind", "payload"])


def parse(files: DataFrame) -> DataFrame:
    """service, relpath, kind, payload of every fact of ``files`` (service, relpath, content)."""
    return files.select("service", "relpath", "content").mapInArrow(_parse, "service string, relpath string, kind string, payload string")


def facts(parsed: DataFrame, kind: str) -> DataFrame:
    """The typed table of one kind."""
    return parsed.where(F.col("kind") == kind).select("service", "relpath", F.from_json("payload", SCHEMAS[kind].replace("def int, path", "`def` int, path")).alias("p")).select("service", "relpath", "p.*")
