"""Symbol occurrences: read from binary indexes, as tables, split into definitions and references.

A binary index is a protobuf message of documents, each with its path, the encoding of its columns
and its occurrences. Only the fields below are read and all others passed over, so no generated code
is needed. One task reads one index, document by document; columns become bytes in a second pass
beside the file's own content, spread over all files.
"""

from __future__ import annotations

import hashlib
import os
from bisect import bisect_left
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFINITION = 1
#: Field numbers of the index format, by message.
DOCUMENTS = 2
RELATIVE_PATH, OCCURRENCES, POSITION_ENCODING = 1, 2, 6
RANGE, SYMBOL, SYMBOL_ROLES = 1, 2, 3
#: Units of columns by code; an index that names none counts in UTF-16, as those of our language do.
ENCODINGS = {0: "utf-16", 1: "utf-8", 2: "utf-16", 3: "utf-32"}
#: Occurrences that one output batch holds.
BATCH = 50_000

OCCURRENCE = "struct<span:array<int>,symbol:string,roles:int>"
DOCUMENT = f"service string, relpath string, encoding string, occurrences array<{OCCURRENCE}>"
ROW = "service string, relpath string, symbol string, start_byte bigint, end_byte bigint, start_line int, roles int, malformed boolean"


class BadIndex(ValueError):
    """The bytes are no index."""


def varint(raw: memoryview, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        if at >= len(raw) or shift > 63:
            raise BadIndex("a number does not end")
        byte = raw[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def fields(raw: memoryview):
    """(number, value) of each field of a message: integers as they are, bytes as views."""
    at = 0
    while at < len(raw):
        key, at = varint(raw, at)
        number, wire = key >> 3, key & 7
        if wire == 0:
            value, at = varint(raw, at)
        else:
            size, at = varint(raw, at) if wire == 2 else ({1: 8, 5: 4}.get(wire, -1), at)
            if size < 0 or at + size > len(raw):
                raise BadIndex(f"field {number} is cut off or of wire type {wire}")
            value, at = raw[at : at + size], at + size
        yield number, value


def signed(value: int) -> int:
    """A 32-bit integer as its varint holds it: negative ones are extended to 64 bits."""
    value &= 0xFFFFFFFF
    return value - (1 << 32) if value >> 31 else value


def occurrence(raw: memoryview) -> dict:
    span, symbol, roles = [], "", 0
    for number, value in fields(raw):
        if number == RANGE and isinstance(value, int):
            span.append(signed(value))
        elif number == RANGE:
            at = 0
            while at < len(value):
                one, at = varint(value, at)
                span.append(signed(one))
        elif number == SYMBOL:
            symbol = bytes(value).decode("utf-8", "replace")
        elif number == SYMBOL_ROLES:
            roles = signed(value)
    return {"span": span, "symbol": symbol, "roles": roles}


def documents(raw: bytes):
    """(path, encoding, occurrences) of each document of an index."""
    for number, value in fields(memoryview(raw)):
        if number == DOCUMENTS:
            path, code, found = "", 0, []
            for n, v in fields(value):
                if n == RELATIVE_PATH:
                    path = bytes(v).decode("utf-8", "replace")
                elif n == POSITION_ENCODING:
                    code = v
                elif n == OCCURRENCES:
                    found.append(occurrence(v))
            yield path, ENCODINGS.get(code, "utf-8"), found


def _read(batches):
    kind = pa.list_(pa.struct([("span", pa.list_(pa.int32())), ("symbol", pa.string()), ("roles", pa.int32())]))
    for batch in batches:
        for service, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            for path, encoding, found in documents(raw):
                arrays = [pa.array([service]), pa.array([path]), pa.array([encoding]), pa.array([found], kind)]
                yield pa.RecordBatch.from_arrays(arrays, names=["service", "relpath", "encoding", "occurrences"])


class Lines:
    """Byte offsets of positions in a text."""

    def __init__(self, content: bytes) -> None:
        self.lines = content.split(b"\n")
        self.starts = [0, *accumulate(len(x) + 1 for x in self.lines)]
        self.units: dict[tuple[int, str], tuple[list[int], list[int]]] = {}

    def clamped(self, line: int) -> int:
        return max(0, min(line, len(self.lines) - 1))

    def byte(self, line: int, column: int, encoding: str) -> int:
        """Offset of a column, at most the end of its line; a column within a character is the character's end."""
        line, column = self.clamped(line), max(0, column)
        raw = self.lines[line]
        if encoding == "utf-8" or raw.isascii():
            return self.starts[line] + min(column, len(raw))
        if (line, encoding) not in self.units:
            width = (lambda c: 2 if ord(c) > 0xFFFF else 1) if encoding == "utf-16" else (lambda c: 1)
            text = raw.decode("utf-8", "surrogateescape")
            size = lambda c: len(c.encode("utf-8", "surrogateescape"))
            self.units[line, encoding] = [0, *accumulate(map(width, text))], [0, *accumulate(map(size, text))]
        units, sizes = self.units[line, encoding]
        return self.starts[line] + sizes[min(bisect_left(units, column), len(sizes) - 1)]


def positions(content: bytes, encoding: str, found: list[dict]):
    """(symbol, start, end, line, roles, malformed) of occurrences; a span has three numbers on one line, four over several."""
    lines = Lines(content)
    for o in found:
        span = o["span"] or []
        if len(span) not in (3, 4):
            yield o["symbol"], None, None, None, o["roles"], True
            continue
        end = (span[0], span[2]) if len(span) == 3 else (span[2], span[3])
        yield o["symbol"], lines.byte(span[0], span[1], encoding), lines.byte(*end, encoding), lines.clamped(span[0]) + 1, o["roles"], False


def _place(batches):
    types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()]
    names = ["service", "relpath", "symbol", "start_byte", "end_byte", "start_line", "roles", "malformed"]
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
    for batch in batches:
        rows: list[tuple] = []
        for k in range(batch.num_rows):
            service, relpath, encoding, found, content = (c[k].as_py() for c in batch.columns)
            for placed in positions(content, encoding, found or []):
                rows.append((service, relpath, *placed))
                if len(rows) >= BATCH:
                    yield pack(rows)
                    rows = []
        if rows:
            yield pack(rows)


def read_indexes(indexes: DataFrame) -> DataFrame:
    """service, relpath, encoding, occurrences of each document of ``indexes`` (service, content)."""
    return indexes.select("service", "content").mapInArrow(_read, DOCUMENT)


def index_files(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """service, content of one index file a service, by a path that Spark can read."""
    out = spark.createDataFrame([], "service string, content binary")
    for service, path in sorted(paths.items()):
        out = out.unionByName(spark.read.format("binaryFile").load(path).select(F.lit(service).alias("service"), "content"))
    return out


def placed(read: DataFrame, files: DataFrame) -> DataFrame:
    """Occurrences of ``read`` in bytes of ``files`` (service, relpath, content); documents whose file is absent are left out.

    Lines are held within the file and columns within their line. ``malformed`` rows have a span of
    neither three nor four numbers, and no position.
    """
    met = read.join(files.select("service", "relpath", "content"), ["service", "relpath"])
    return met.select("service", "relpath", "encoding", "occurrences", "content").mapInArrow(_place, ROW)


def reader_stats(read: DataFrame, files: DataFrame, rows: DataFrame) -> DataFrame:
    """service, documents, skipped_documents, defs, refs, malformed_ranges."""
    known = files.select("service", "relpath").distinct().withColumn("known", F.lit(True))
    docs = read.select("service", "relpath").join(known, ["service", "relpath"], "left").groupBy("service").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("known").isNull()).alias("skipped_documents"))
    bit = F.col("roles").bitwiseAND(F.lit(DEFINITION)) != 0
    counts = rows.groupBy("service").agg(F.count_if(~F.col("malformed") & bit).alias("defs"), F.count_if(~F.col("malformed") & ~bit).alias("refs"), F.count_if("malformed").alias("malformed_ranges"))
    return docs.join(counts, "service", "left").na.fill(0)


def cached_index(folder: str, service: str, tree_hash: str, make) -> tuple[str, bool]:
    """(path, whether it was there): the index of a service whose files have this tree hash; ``make(path)`` writes one that is not.

    It is written beside its place and renamed, so that a run that fails or is stopped leaves none.
    """
    path = os.path.join(folder, f"{service}-{tree_hash}.index")
    if os.path.exists(path):
        return path, True
    os.makedirs(folder, exist_ok=True)
    part = f"{path}.{hashlib.sha256(os.urandom(16)).hexdigest()[:12]}"
    try:
        make(part)
        os.replace(part, path)
    finally:
        if os.path.exists(part):
            os.remove(part)
    return path, False


def usable(rows: DataFrame) -> DataFrame:
    """Spans that are not empty or reversed."""
    return rows.where("start_byte >= 0 AND end_byte > start_byte")


def split_occurrences(rows: DataFrame) -> DataFrame:
    """Usable occurrences with ``kind``: a def if the definition bit is set, else a ref."""
    return usable(rows).withColumn("kind", F.when(F.col("roles").bitwiseAND(F.lit(DEFINITION)) != 0, "def").otherwise("ref"))
