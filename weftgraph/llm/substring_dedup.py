"""Substring deduplication by difference-cover anchors.

A window is ``WINDOW`` (13) consecutive words of a document; a word goes if a window that covers it
also starts in a document with a smaller id. Positions modulo 7 in {0, 1, 3} are a difference
cover: for any two positions there is a shift below 7 that brings both onto the cover. So two equal
windows share an anchor of 13 - 6 = 7 words that starts on the cover in both. Only those anchors
are hashed (three of seven positions); a window is looked at further only if it holds an anchor
that another document has too. Such windows are then extended to their 13 words.

How it runs: rows are dealt at random, with a fixed seed, to groups of about ``GROUP_BYTES`` of text,
whatever the size of the corpus and however often a row is repeated. A group sends the distinct
hashes of its anchors, packed by hash bucket. A bucket answers with one bit per hash: met in another
group or not. The group then sends its candidate windows the same way, with the smallest id that has
each, and gets back one bit each: a smaller id elsewhere or not. A passage in a third of all
documents sends one hash per group and never one per document. Texts are shuffled once, and the three
steps that read them share that shuffle.

Memory: a group holds its words and some arrays of eight bytes a word, a bucket about
``BUCKET_HASHES`` hashes and, for each hash that many groups have, as many as there are groups. Both
bounds are constants, so a larger corpus has more groups and more buckets, not larger ones; messages
shrink with that, down to one hash each.

Windows are compared by hashes and not by their words: a key of 64 bits and, independent of it, the
bucket's number. Among n distinct candidate windows a wrong removal is
expected n * n / 2 ** (65 + bits of a bucket's number) times: below one in a million for a billion
candidates, whose corpus has some 2 ** 16 buckets or more.

Defined cases: a null or empty text has no words; a document of under 13 words stays whole; rows
with a null id stay whole and cause no removal; rows with equal ids do not cause removal in each
other; an empty table gives an empty result; other columns are ignored. The dealing follows the order
of rows within a task, which a table or a checkpoint gives again when a task is run anew; give this
operator one of those.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import utf8

WINDOW, PERIOD, COVER = 13, 7, (0, 1, 3)
ANCHOR = WINDOW - PERIOD + 1
#: Sizes of a group in bytes of text (a longer text is a group's only limit), and of a bucket in hashes.
GROUP_BYTES, BUCKET_HASHES, SEED = 4 << 20, 1 << 20, 13
LOW = np.uint64((1 << 48) - 1)
FACTORS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))
MESSAGE = "bucket bigint, g bigint, hashes binary, ids binary"
ANSWER = "g bigint, round int, bucket bigint, bits binary"


def stirred(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def windows(hashes: np.ndarray, starts: np.ndarray, n: int, factor: np.uint64) -> np.ndarray:
    out = hashes[starts].copy()
    for k in range(1, n):
        out *= factor
        out += hashes[starts + k]
    return stirred(out)


def runs(*sorted_by: np.ndarray) -> np.ndarray:
    """First places of equal values in sorted arrays."""
    n = len(sorted_by[0])
    if not n:
        return np.zeros(0, np.int64)
    new = np.zeros(n, bool)
    new[0] = True
    for x in sorted_by:
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


class Group:
    """The documents of a group; every array is the same however the rows arrive."""

    def __init__(self, table: pa.Table, bucket_bits: int) -> None:
        self.shift = np.uint64(64 - bucket_bits)
        self.ids = table.column("doc_id").to_pylist()
        self.words = [t.split() for t in table.column("text").to_pylist()]
        counts = np.array([len(w) for w in self.words], np.int64)
        self.first = np.cumsum(counts) - counts
        digest = xxhash.xxh3_64_intdigest
        self.hashes = np.fromiter((digest(w) for ws in self.words for w in ws), np.uint64, int(counts.sum()))
        known = np.array([i is not None for i in self.ids], bool)
        usable = np.repeat(known & (counts >= WINDOW), counts)
        within = np.arange(len(self.hashes)) - np.repeat(self.first, counts)
        left = np.repeat(counts, counts) - within
        self.owner = np.repeat(np.array([i or 0 for i in self.ids], np.int64), counts)
        self.starts_window = usable & (left >= WINDOW)
        on_cover = np.isin(np.arange(PERIOD), COVER)[within % PERIOD]
        self.anchors = np.flatnonzero(usable & on_cover & (left >= ANCHOR))

    def bucket_of(self, h: np.ndarray) -> np.ndarray:
        return h >> self.shift if int(self.shift) < 64 else np.zeros(len(h), np.uint64)

    def anchor_keys(self) -> None:
        h = windows(self.hashes, self.anchors, ANCHOR, FACTORS[0])
        bucket, low = self.bucket_of(h), h & LOW
        self.anchor_order = np.lexsort((low, bucket))
        bucket, low = bucket[self.anchor_order], low[self.anchor_order]
        at = runs(bucket, low)
        owners = self.owner[self.anchors][self.anchor_order]
        self.anchor_runs = at
        self.anchor_bucket, self.anchor_low = bucket[at], low[at]
        self.anchor_shared = np.minimum.reduceat(owners, at) != np.maximum.reduceat(owners, at) if len(at) else np.zeros(0, bool)

    def window_keys(self, shared: np.ndarray) -> None:
        """Candidate windows: those that hold a shared anchor, where ``shared`` is by distinct anchor."""
        sizes = np.diff(np.append(self.anchor_runs, len(self.anchor_order)))
        p = self.anchors[self.anchor_order[np.repeat(shared, sizes)]]
        edge = np.zeros(len(self.hashes) + 1, np.int64)
        np.add.at(edge, np.maximum(p - (PERIOD - 1), 0), 1)
        np.add.at(edge, p + 1, -1)
        self.candidates = np.flatnonzero((np.cumsum(edge)[:-1] > 0) & self.starts_window)
        key = windows(self.hashes, self.candidates, WINDOW, FACTORS[1])
        bucket = self.bucket_of(windows(self.hashes, self.candidates, WINDOW, FACTORS[2]))
        self.window_order = np.lexsort((key, bucket))
        key, bucket = key[self.window_order], bucket[self.window_order]
        self.window_runs = runs(bucket, key)
        owners = self.owner[self.candidates][self.window_order]
        at = self.window_runs
        self.window_bucket, self.window_key = bucket[at], key[at]
        self.window_least = np.minimum.reduceat(owners, at) if len(at) else np.zeros(0, np.int64)

    def removed(self, smaller_elsewhere: np.ndarray) -> np.ndarray:
        sizes = np.diff(np.append(self.window_runs, len(self.window_order)))
        starts = self.candidates[self.window_order]
        gone = np.repeat(smaller_elsewhere, sizes) | (np.repeat(self.window_least, sizes) < self.owner[starts])
        edge = np.zeros(len(self.hashes) + 1, np.int64)
        np.add.at(edge, starts[gone], 1)
        np.add.at(edge, starts[gone] + WINDOW, -1)
        return np.cumsum(edge)[:-1] > 0


def six_bytes(low: np.ndarray) -> bytes:
    return np.ascontiguousarray(low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def joined(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column without an object for each value, and the lengths."""
    parts = [(np.frombuffer(c.buffers()[2] or b"", np.uint8), np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1]) for c in column.chunks if len(c)]
    if not parts:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64)
    return np.concatenate([data[at[0] : at[-1]] for data, at in parts]), np.concatenate([np.diff(at) for _, at in parts]).astype(np.int64)


def from_six_bytes(raw: np.ndarray) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = raw.reshape(-1, 6)
    return out.view("<u8").reshape(-1)


def table_of(schema: str, columns: list[list]) -> pa.Table:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    fields = [part.split() for part in schema.split(", ")]
    return pa.table({name: pa.array(c, kinds[kind]) for (name, kind), c in zip(fields, columns, strict=True)})


def packed(g: int, bucket: np.ndarray, encoded, ids: np.ndarray | None) -> pa.Table:
    at = runs(bucket)
    ends = np.append(at[1:], len(bucket))[: len(at)]
    rows = [(int(bucket[a]), g, encoded(slice(a, b)), ids[a:b].astype("<i8").tobytes() if ids is not None else None) for a, b in zip(at, ends, strict=True)]
    return table_of(MESSAGE, [list(c) for c in zip(*rows, strict=True)] if rows else [[]] * 4)


def bits_for(answers: pa.Table, round_: int, bucket: np.ndarray) -> np.ndarray:
    """The bits of a round, in the order of the message's hashes; False where no answer came."""
    out = np.zeros(len(bucket), bool)
    for r, b, bits in zip(answers.column("round").to_pylist(), answers.column("bucket").to_pylist(), answers.column("bits").to_pylist(), strict=True):
        if r == round_:
            lo, hi = np.searchsorted(bucket, np.uint64(b), "left"), np.searchsorted(bucket, np.uint64(b), "right")
            out[lo:hi] = np.unpackbits(np.frombuffer(bits, np.uint8), count=hi - lo).astype(bool)
    return out


def send_anchors(bucket_bits: int):
    def run(table: pa.Table) -> pa.Table:
        group = Group(table, bucket_bits)
        group.anchor_keys()
        return packed(table.column("g")[0].as_py(), group.anchor_bucket, lambda s: six_bytes(group.anchor_low[s]), None)

    return run


def answer_anchors(table: pa.Table) -> pa.Table:
    raw, lengths = joined(table.column("hashes"))
    every = from_six_bytes(raw)
    order = np.argsort(every, kind="stable")
    at = runs(every[order])
    often = np.diff(np.append(at, len(every))) > 1
    flags = np.empty(len(every), bool)
    flags[order] = np.repeat(often, np.diff(np.append(at, len(every))))
    return answered(table, 1, flags, lengths // 6)


def answered(table: pa.Table, round_: int, flags: np.ndarray, sizes: np.ndarray) -> pa.Table:
    """Only messages that have some bit set are answered."""
    ends = np.cumsum(sizes)
    some = np.flatnonzero(np.logical_or.reduceat(flags, ends - sizes)) if len(flags) else np.zeros(0, np.int64)
    bits = [np.packbits(flags[ends[k] - sizes[k] : ends[k]]).tobytes() for k in some]
    return pa.table({"g": table.column("g").take(pa.array(some)), "round": pa.array([round_] * len(some), pa.int32()), "bucket": table.column("bucket").take(pa.array(some)), "bits": pa.array(bits, pa.binary())})


def send_windows(bucket_bits: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows or not answers.num_rows and table.num_rows < 2:
            return table_of(MESSAGE, [[]] * 4)
        group = Group(table, bucket_bits)
        group.anchor_keys()
        group.window_keys(group.anchor_shared | bits_for(answers, 1, group.anchor_bucket))
        return packed(table.column("g")[0].as_py(), group.window_bucket, lambda s: group.window_key[s].astype("<u8").tobytes(), group.window_least)

    return run


def answer_windows(table: pa.Table) -> pa.Table:
    raw, lengths = joined(table.column("hashes"))
    every, ids = raw.view("<u8"), joined(table.column("ids"))[0].view("<i8")
    order = np.argsort(every, kind="stable")
    at = runs(every[order])
    least = np.minimum.reduceat(ids[order], at)
    flags = np.empty(len(every), bool)
    flags[order] = np.repeat(least, np.diff(np.append(at, len(every)))) < ids[order]
    return answered(table, 2, flags, lengths // 8)


RESULT = "doc_id bigint, n_words bigint, n_removed bigint, kept_text string"


def remove(bucket_bits: int):
    def run(table: pa.Table, answers: pa.Table) -> pa.Table:
        if not table.num_rows:
            return table_of(RESULT, [[]] * 4)
        group = Group(table, bucket_bits)
        group.anchor_keys()
        group.window_keys(group.anchor_shared | bits_for(answers, 1, group.anchor_bucket))
        gone = group.removed(bits_for(answers, 2, group.window_bucket))
        rows = []
        for doc_id, words, at in zip(group.ids, group.words, group.first, strict=True):
            mine = gone[at : at + len(words)]
            n = int(mine.sum())
            kept = [w for w, g in zip(words, mine.tolist(), strict=True) if not g] if n else words
            rows.append((doc_id, len(words), n, b" ".join(kept).decode("utf-8", "replace")))
        return table_of(RESULT, [list(c) for c in zip(*rows, strict=True)])

    return run


def deal(rows: DataFrame, groups: int) -> DataFrame:
    return rows.withColumn("g", F.floor(F.rand(SEED) * groups).cast("bigint"))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_removed, kept_text``: a row for each document, kept words joined by a space."""
    given = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), utf8(F.col(text_col)).alias("text"))
    total = given.select(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = max(1, -(-total // GROUP_BYTES))
    hashes = total / 6 * len(COVER) / PERIOD
    bucket_bits = max(0, math.ceil(math.log2(max(1.0, hashes / BUCKET_HASHES))))
    dealt = deal(given, groups)
    anchors = dealt.groupBy("g").applyInArrow(send_anchors(bucket_bits), MESSAGE)
    met = anchors.groupBy("bucket").applyInArrow(answer_anchors, ANSWER)
    sent = dealt.groupBy("g").cogroup(met.groupBy("g")).applyInArrow(send_windows(bucket_bits), MESSAGE)
    smaller = sent.groupBy("bucket").applyInArrow(answer_windows, ANSWER)
    return dealt.groupBy("g").cogroup(met.unionByName(smaller).groupBy("g")).applyInArrow(remove(bucket_bits), RESULT)


def op8_substring_dedup(spark, sf_dir: str) -> DataFrame:
    found = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), v AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)
), late AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS first FROM v) WHERE first < doc_id
), gone AS (
  SELECT DISTINCT doc_id, i + k AS i FROM late, range(13) AS r(k)
), words AS (
  SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM d
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
