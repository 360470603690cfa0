"""SimHash near-duplicates: tiled exact comparison with exclusive-or and bit counts.

A fingerprint has a bit for each bit of the 64-bit shingle hashes: 1 if set in over half of them.
Wider fingerprints add words whose hashes are mixed from the first. Equal fingerprints are one
node. Nodes are dealt to tiles by the bit counts of parts ("lanes") of the fingerprint, and a tile
of many nodes is split by hash. Two fingerprints that differ in at most ``radius`` bits have bit
counts that differ by no more than that, summed over the lanes, so all other tile pairs are skipped
unread; within a pair, rows are sorted by bit count and the same bound cuts the rows to compare.
What is left is compared exactly with numpy. So no link is lost.

A pair of tiles returns a spanning forest of its links and not the links, so a group of copies
gives as many rows as it has members. Components come from alternating stars over the forests.

With ``min_ratio`` two texts are linked only if the smaller has at least that share of the larger
one's shingles, which any pair of that Jaccard similarity has; tiles are then dealt by size as well.

Scale: texts are read once and only fingerprints are kept. A tile is bounded, so is a task's
memory. The pairs compared grow with the square of the distinct fingerprints times the share that
the lanes leave (1.4 percent for four lanes at radius 2); that is the price of an exact comparison.

Defined cases: a text without words (null, empty, blank) has fingerprint zero and is linked like
any other; null ids are carried, are never the smallest, and a component of null ids has a null id;
repeated rows are each returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm.common import only, utf8
from weftgraph.llm.components import roots
from weftgraph.session import cut

#: Rows of a tile; rows and shingles of a tile whose sets are compared.
TILE = 8192
PART, PART_SHINGLES = 1024, 1 << 19
SEED = 42


def shingle_hashes(raw: bytes, width: int, distinct: bool) -> np.ndarray:
    words = raw.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    n = max(1, len(words) - width + 1)
    stops = ends[min(width, len(words)) - 1 :]
    parts = [joined[a:b] for a, b in zip(starts[:n].tolist(), stops.tolist(), strict=True)]
    if distinct:
        parts = set(parts)
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(s, SEED) for s in parts), np.uint64, len(parts))


def mixed(h: np.ndarray) -> np.ndarray:
    """Another 64 bits from a hash (the finaliser of SplitMix64)."""
    h = h + np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprint(h: np.ndarray, words: int) -> list[int]:
    out = []
    for k in range(words):
        h = mixed(h) if k else h
        if not len(h):
            out.append(0)
            continue
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduce(bits, axis=0, dtype=np.uint32)
        out.append(int(np.packbits(2 * ones > len(h), bitorder="little").view(np.int64)[0]))
    return out


def printer(width: int, words: int, distinct: bool):
    names = ["doc_id", "size", *(f"f{k}" for k in range(words))]

    def run(batches):
        for batch in batches:
            sizes, prints = [], []
            for at in range(0, batch.num_rows, 256):
                for raw in batch.column(1).slice(at, 256).to_pylist():
                    h = shingle_hashes(raw, width, distinct)
                    sizes.append(len(h))
                    prints.append(fingerprint(h, words))
            columns = [pa.array([p[k] for p in prints], pa.int64()) for k in range(words)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *columns], names=names)

    return run


def fingerprints(docs: DataFrame, id_col: str, text_col: str, width: int, words: int, distinct: bool) -> DataFrame:
    given = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), utf8(F.col(text_col)).alias("text"))
    return given.mapInArrow(printer(width, words, distinct), "doc_id bigint, size bigint, " + ", ".join(f"f{k} bigint" for k in range(words)))


def near_classes(lanes: int, step: int, radius: int, bands: bool) -> list[tuple[int, ...]]:
    """Offsets (band, lane...) of the tiles that can hold a link, one of each two opposite ones."""
    far = (radius + step - 1) // step
    least = lambda d: sum(max(0, abs(x) * step - (step - 1)) for x in d)
    ball = [d for d in product(range(-far, far + 1), repeat=lanes) if least(d) <= radius]
    return [(b, *d) for b in ((0, 1) if bands else (0,)) for d in ball if b or d >= (0,) * lanes]


def local_forest(a: np.ndarray, b: np.ndarray | None, size_a: np.ndarray, size_b: np.ndarray | None, radius: int, ratio: float) -> np.ndarray:
    """Labels (an index of the same component) of the rows of ``a`` and then of ``b``; without ``b``, within ``a``."""
    alone = b is None
    if alone:
        b, size_b = a, size_a
    count = lambda x: np.bitwise_count(x).sum(axis=1, dtype=np.int64)
    order_a, order_b = np.argsort(count(a), kind="stable"), np.argsort(count(b), kind="stable")
    a, b, size_a, size_b = a[order_a], b[order_b], size_a[order_a], size_b[order_b]
    ones_a, ones_b = count(a), count(b)
    index_a = order_a
    index_b = order_b if alone else order_b + len(a)
    label = np.arange(len(a) if alone else len(a) + len(b))
    block = 128
    for at in range(0, len(a), block):
        rows = slice(at, min(at + block, len(a)))
        lo = np.searchsorted(ones_b, ones_a[rows][0] - radius, "left")
        hi = np.searchsorted(ones_b, ones_a[rows][-1] + radius, "right")
        if alone:
            lo = max(lo, at)
        if lo >= hi:
            continue
        apart = np.bitwise_count(a[rows, 0][:, None] ^ b[None, lo:hi, 0])
        if a.shape[1] > 1:
            apart = apart.astype(np.uint16)
            for k in range(1, a.shape[1]):
                apart += np.bitwise_count(a[rows, k][:, None] ^ b[None, lo:hi, k])
        i, j = np.nonzero(apart <= radius)
        i, j = i + at, j + lo
        if ratio:
            small, large = np.minimum(size_a[i], size_b[j]), np.maximum(size_a[i], size_b[j])
            fits = small >= ratio * large
            i, j = i[fits], j[fits]
        i, j = index_a[i], index_b[j]
        while True:
            label = label[label]
            x, y = label[i], label[j]
            differ = x != y
            if not differ.any():
                break
            i, j, x, y = i[differ], j[differ], x[differ], y[differ]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
    while (nxt := label[label]).tolist() != label.tolist():
        label = nxt
    return label


def comparer(words: int, radius: int, ratio: float):
    def table(lists, row):
        flat = lists.slice(row, 1).flatten()
        field = lambda name: flat.field(name).to_numpy(zero_copy_only=False)
        return field("id"), field("size"), np.stack([field(f"f{k}") for k in range(words)], axis=1).view(np.uint64)

    def run(batches):
        for batch in batches:
            us, vs = [], []
            for row in range(batch.num_rows):
                ids, sizes, prints = table(batch.column(0), row)
                if batch.column(1).is_valid()[row].as_py():
                    ids_b, sizes_b, prints_b = table(batch.column(1), row)
                    label = local_forest(prints, prints_b, sizes, sizes_b, radius, ratio)
                    ids = np.concatenate([ids, ids_b])
                else:
                    label = local_forest(prints, None, sizes, None, radius, ratio)
                linked = np.flatnonzero(label != np.arange(len(label)))
                us.append(ids[linked])
                vs.append(ids[label[linked]])
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us)), pa.array(np.concatenate(vs))], names=["u", "v"])

    return run


def links(nodes: DataFrame, words: int, radius: int, lanes: int, step: int, ratio: float) -> DataFrame:
    """``u, v``: spanning forests of all links among ``nodes`` (id, size, f0...), tile pair by tile pair."""
    part = 64 * words // lanes
    base = 1000

    def ones(lane: int):
        if part >= 64:
            return sum((F.bit_count(F.col(f"f{lane * part // 64 + k}")) for k in range(1, part // 64)), F.bit_count(F.col(f"f{lane * part // 64}")))
        cell, shift = divmod(lane * part, 64)
        return F.bit_count(F.shiftrightunsigned(f"f{cell}", shift).bitwiseAND(F.lit((1 << part) - 1)))

    kind = F.lit(0).cast("bigint")
    for lane in range(lanes):
        kind = kind * base + F.floor(ones(lane) / step)
    if ratio:
        kind = kind + F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / float(-np.log(ratio))) * base**lanes
    dealt = cut(nodes.withColumn("kind", kind.cast("bigint")))
    counted = dealt.groupBy("kind").count()
    dealt = dealt.join(counted, "kind").withColumn("tile", F.struct("kind", F.pmod(F.xxhash64(F.lit(5), "id"), F.ceil(F.col("count") / TILE)).alias("part")))
    cells = F.collect_list(F.struct("id", "size", *(f"f{k}" for k in range(words)))).alias("cells")
    tiles = cut(dealt.groupBy("tile").agg(cells))
    keys = tiles.select("tile", "tile.kind")
    offsets = [sum(x * base ** (lanes - 1 - k) for k, x in enumerate(d)) + b * base**lanes for b, *d in near_classes(lanes, step, radius, bool(ratio))]
    near = keys.select(F.col("tile").alias("a"), F.explode(F.array(*(F.col("kind") + o for o in offsets))).alias("kind"))
    pairs = near.join(keys.withColumnRenamed("tile", "b"), "kind").where("a.kind != b.kind OR a.part <= b.part").select("a", "b")
    left = tiles.select(F.col("tile").alias("a"), F.col("cells").alias("cells_a"))
    right = tiles.select(F.col("tile").alias("b"), F.col("cells").alias("cells_b"))
    loaded = pairs.join(left, "a").join(right, "b").select("cells_a", F.when(F.col("a") != F.col("b"), F.col("cells_b")).alias("cells_b"))
    return loaded.mapInArrow(comparer(words, radius, ratio), "u bigint, v bigint")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 3,
    radius: int = 2,
    words: int = 1,
    distinct: bool = False,
    min_ratio: float = 0.0,
    lanes: int = 4,
    step: int = 1,
) -> DataFrame:
    """``doc_id, size, f0..., component_id``: a row for each document."""
    prints = [f"f{k}" for k in range(words)]
    if words == 1 and not min_ratio:
        node = F.col("f0")
    else:
        node = F.xxhash64("size", *prints) if min_ratio else F.xxhash64(*prints)
    made = cut(fingerprints(docs, id_col, text_col, width, words, distinct).withColumn("id", node))
    nodes = made.groupBy("id").agg(F.min("doc_id").alias("first"), F.max("size").alias("size"), *(F.min(f).alias(f) for f in prints))
    nodes = cut(nodes)
    root = roots(links(nodes.drop("first"), words, radius, lanes, step, min_ratio))
    rooted = cut(nodes.select("id", "first").join(root.withColumnRenamed("u", "id"), "id", "left").select("id", "first", F.coalesce("root", "id").alias("root")))
    least = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id")))  # both sides plain, so that a large component can be split
    labels = cut(rooted.select("id", "root").join(least, "root").select("id", "component_id"))
    return made.join(labels, "id").select("doc_id", "size", *prints, "component_id")


def set_id(h: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(h.tobytes(), SEED) - 2**63


def set_writer(width: int):
    """``id, hashes``: each text's sorted set of shingle hashes under its id."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [np.sort(shingle_hashes(raw, width, True)) for raw in batch.column(0).slice(at, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array([set_id(h) for h in sets], pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary())], names=["id", "hashes"])

    return run


def band_keys(h: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """MinHash keys: sets of Jaccard similarity J share one of them with probability 1 - (1 - J ** rows) ** bands."""
    if not len(h):
        return np.zeros(0, np.int64)
    factor = mixed(np.arange(1, bands * rows + 1, dtype=np.uint64)) | np.uint64(1)
    least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 1024):
        np.minimum(least, (h[at : at + 1024, None] * factor).min(axis=0), out=least)
    least = least.reshape(bands, rows)
    key = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        key = mixed(key ^ least[:, k])
    return key.view(np.int64)


def copy_printer(width: int, words: int, bands: int, rows: int):
    """Like ``printer``, with ``id`` (a hash of the shingle set) and its band keys."""
    names = ["doc_id", "text_key", "id", "size", *(f"f{k}" for k in range(words)), "keys"]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                sets = [np.sort(shingle_hashes(raw, width, True)) for raw in batch.column(2).slice(at, 256).to_pylist()]
                prints = [fingerprint(h, words) for h in sets]
                columns = [
                    batch.column(0).slice(at, 256),
                    batch.column(1).slice(at, 256),
                    pa.array([set_id(h) for h in sets], pa.int64()),
                    pa.array([len(h) for h in sets], pa.int64()),
                    *(pa.array([p[k] for p in prints], pa.int64()) for k in range(words)),
                    pa.array([band_keys(h, bands, rows) for h in sets], pa.list_(pa.int64())),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def exact_forest(prints: np.ndarray, sets: list[np.ndarray], known: np.ndarray, side: np.ndarray | None, radius: int, few: int, ratio: float) -> list[tuple[int, int]]:
    """Links (pairs of rows) that join all rows whose sets have at least the Jaccard similarity ``ratio``.

    Rows of one ``known`` label are joined already; with ``side``, only rows of different sides are
    compared. Pairs of one label are not compared again, so a group of copies costs about a comparison
    for each member. Prints that differ in more than ``radius`` bits are passed over by exclusive-or and
    bit counts, unless the sets are small."""
    sizes = np.array([len(s) for s in sets])
    order = np.argsort(sizes, kind="stable")
    sizes, prints = sizes[order], prints[order]
    label = np.unique(known[order], return_inverse=True)[1]
    side = None if side is None else side[order]
    found = []
    for i in range(len(order) - 1):
        hi = np.searchsorted(sizes, sizes[i] / ratio + 1e-9, "right")
        open_ = label[i + 1 : hi] != label[i]
        if side is not None:
            open_ &= side[i + 1 : hi] != side[i]
        if sizes[i] > few:
            open_ &= np.bitwise_count(prints[i + 1 : hi] ^ prints[i]).sum(axis=1, dtype=np.int64) <= radius
        js = np.flatnonzero(open_) + i + 1
        if not len(js) or not sizes[i]:
            continue
        for at in range(0, len(js), 128):
            some = js[at : at + 128]
            some = some[label[some] != label[i]]
            if not len(some):
                continue
            hit = np.isin(np.concatenate([sets[order[j]] for j in some]), sets[order[i]])
            both = np.add.reduceat(hit, np.concatenate([[0], np.cumsum(sizes[some])[:-1]]), dtype=np.int64)
            alike = some[both >= ratio * (sizes[i] + sizes[some] - both) - 1e-9]
            labels, at_ = np.unique(label[alike], return_index=True)
            if len(labels):
                found += [(int(order[i]), int(order[j])) for j in alike[at_]]
                label[np.isin(label, labels)] = label[i]
    return found


def confirmer(words: int, radius: int, few: int, ratio: float):
    def run(batches):
        for batch in batches:
            for row in range(batch.num_rows):
                flat = [c.slice(row, 1).flatten() for c in batch.columns if c.is_valid()[row].as_py()]
                field = lambda name: np.concatenate([x.field(name).to_numpy(zero_copy_only=False) for x in flat])  # noqa: B023, E731
                ids, prints = field("id"), np.stack([field(f"f{k}") for k in range(words)], axis=1).view(np.uint64)
                side = np.repeat([0, 1], [len(x) for x in flat]) if len(flat) > 1 else None
                links_ = exact_forest(prints, [np.frombuffer(b, np.uint64) for b in field("hashes")], field("label"), side, radius, few, ratio)
                yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i, _ in links_], pa.int64()), pa.array([ids[j] for _, j in links_], pa.int64())], names=["u", "v"])

    return run


def tiles_of(members: DataFrame, kept: list[str]) -> DataFrame:
    """``root, band, kind, part, cells``: the rows of each (root, band, kind) in parts of bounded rows and bytes."""
    key = ["root", "band", "kind"]
    need = F.ceil(F.greatest(F.count(F.lit(1)) / PART, F.sum("size") / PART_SHINGLES))
    counted = cut(members.groupBy(*key).agg(need.alias("parts")))
    dealt = members.join(counted, key).withColumn("part", F.pmod(F.xxhash64(F.lit(5), "id"), F.col("parts")))
    return cut(dealt.groupBy(*key, "part").agg(F.collect_list(F.struct(*kept)).alias("cells")))


def loaded(tiles: DataFrame, alone: DataFrame, pairs: DataFrame, key: list[str]) -> DataFrame:
    """``cells, more``: the tiles of ``alone`` by themselves, and those of ``pairs`` (a, b: structs of ``key``) together."""
    at = tiles.select(F.struct(*key).alias("at"), "cells")
    none = F.lit(None).cast(tiles.schema["cells"].dataType).alias("more")
    one = at.join(alone.select(F.struct(*key).alias("at")), "at", "left_semi").select("cells", none)
    left = at.select(F.col("at").alias("a"), "cells")
    right = at.select(F.col("at").alias("b"), F.col("cells").alias("more"))
    return one.unionByName(pairs.join(left, "a").join(right, "b").select("cells", "more"))


def confirmed(members: DataFrame, sets: DataFrame, words: int, radius: int, few: int, ratio: float) -> DataFrame:
    """``u, root``: components by the exact links within each group ``root`` of ``members`` (id, root, size, f0...), by ``sets`` (id, hashes).

    A group's members are dealt to tiles by the population count of their shingle vectors (bands of
    the logarithm of the size); tiles that are two bands apart cannot hold a link and are skipped.
    First each tile is compared within itself and with the first tile of its band and of the bands
    next to it. That joins a group of near copies of any size at a cost linear in it. Only if a group
    of more tiles is then not yet one component are its other tiles compared, rows of one large
    component never with each other."""
    kept = ["id", "label", "size", *(f"f{k}" for k in range(words)), "hashes"]
    key = ["root", "band", "kind", "part"]
    compare = lambda rows: rows.mapInArrow(confirmer(words, radius, few, ratio), "u bigint, v bigint")
    band = F.floor(F.log(F.greatest("size", F.lit(1)).cast("double")) / float(-np.log(ratio)))
    given = members.withColumns({"band": band, "kind": F.lit(0).cast("bigint"), "label": F.col("id")})
    tiles = tiles_of(sets.join(given, "id"), kept)
    keys = cut(tiles.select(*key))
    first = keys.where("part = 0").select("root", F.col("band").alias("other"), F.struct(*key).alias("b"))
    pairs = keys.select("root", "band", "part", F.struct(*key).alias("a"), F.explode(F.array(*(F.col("band") + d for d in (-1, 0, 1)))).alias("other")).join(first, ["root", "other"])
    pairs = cut(pairs.where("part != 0 OR other > band").select("a", "b"))
    links_ = cut(compare(loaded(tiles, keys, pairs, key)))
    root = roots(links_)
    several = cut(keys.where("part > 0").select("root").distinct())
    if several.isEmpty():
        return root
    labels = members.select("id", "root").join(several, "root", "left_semi").join(root.select(F.col("u").alias("id"), F.col("root").alias("top")), "id", "left")
    labels = cut(labels.select("id", "root", F.coalesce("top", "id").alias("label")))
    open_ = labels.groupBy("root").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo != hi").select("root")
    again = tiles.join(open_, "root", "left_semi").select("root", "band", F.explode("cells").alias("c")).select("root", "band", *(F.col(f"c.{x}").alias(x) for x in kept if x != "label"))
    again = again.join(labels.select("id", "label"), "id")
    large = cut(again.groupBy("root", "band", "label").count().where(F.col("count") >= PART).select("root", "band", "label", F.col("label").alias("own")))
    again = again.join(large, ["root", "band", "label"], "left").withColumn("kind", F.coalesce("own", F.lit(0).cast("bigint"))).drop("own")
    tiles = tiles_of(again, kept)
    keys = cut(tiles.select("root", "band", "kind", F.struct(*key).alias("at")))  # cut: aliases of aliases make planning slow
    other = keys.select("root", F.col("band").alias("band_b"), F.col("kind").alias("kind_b"), F.col("at").alias("b"))
    mixed_ = keys.where("kind = 0").join(other, "root").where("abs(band - band_b) <= 1 AND (kind_b != 0 OR at < b)")
    torn = large.groupBy("root").agg(F.min("own").alias("lo"), F.max("own").alias("hi")).where("lo != hi").select("root")
    apart = keys.where("kind != 0").join(torn, "root", "left_semi").join(other.where("kind_b != 0"), "root").where("abs(band - band_b) <= 1 AND kind < kind_b")
    pairs = cut(mixed_.unionByName(apart).select(F.col("at").alias("a"), "b"))
    more = compare(loaded(tiles, cut(keys.where("kind = 0").select("at.*")), pairs, key))
    return roots(links_.unionByName(more))


def near_copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = 5,
    ratio: float = 0.8,
    bands: int = 32,
    rows: int = 5,
    radius: int = 44,
    few: int = 64,
    words: int = 2,
) -> DataFrame:
    """``doc_id, text_key, size, component_id, component``: components of the texts whose sets of shingles have at least the Jaccard similarity ``ratio``.

    At that similarity some 15 percent of a print's bits differ and the bit counts of unlike texts lie
    closer than that, so no bound on bit counts skips any tile of a whole corpus. Groups of candidates
    are therefore the texts that share a MinHash band key, and their chains: at 0.8 and the defaults a
    pair is missed with probability 3e-6. Within a group the prints are compared tile by tile, and each
    link is confirmed by the sets of shingle hashes. ``text_key`` is ``xxhash64`` of the text;
    ``component`` tells components apart even if an id has texts in several.
    """
    prints = [f"f{k}" for k in range(words)]
    given = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text_col).alias("text_key"), utf8(F.col(text_col)).alias("text"))
    schema = "doc_id bigint, text_key bigint, id bigint, size bigint, " + ", ".join(f"{f} bigint" for f in prints) + ", keys array<bigint>"
    made = cut(given.mapInArrow(copy_printer(width, words, bands, rows), schema))
    nodes = cut(made.groupBy("id").agg(F.min("doc_id").alias("first"), F.max("size").alias("size"), *(F.min(f).alias(f) for f in prints)))
    keyed = cut(made.select("id", F.explode("keys").alias("h")).distinct())
    heads = keyed.groupBy("h").agg(F.min("id").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "v")
    maybe = cut(roots(keyed.join(cut(heads), "h").where("id != v").select(F.col("id").alias("u"), "v")))
    grouped = cut(maybe.select(F.col("u").alias("id"), "root").unionByName(maybe.select(F.col("root").alias("id"), "root").distinct()))
    members = cut(nodes.select("id", "size", *prints).join(grouped, "id"))
    # sets are larger than texts, so they are not kept from above but made again for the members, each from one text
    wanted = cut(made.select("id", "text_key").join(members.select("id"), "id").groupBy("id").agg(F.min("text_key").alias("text_key")).select("text_key"))
    sets = only(given, "text_key", wanted).select("text").mapInArrow(set_writer(width), "id bigint, hashes binary").groupBy("id").agg(F.min("hashes").alias("hashes"))
    root = confirmed(members, sets, words, radius, few, ratio)
    rooted = cut(nodes.select("id", "first").join(root.withColumnRenamed("u", "id"), "id", "left").select("id", "first", F.coalesce("root", "id").alias("root")))
    least = cut(rooted.groupBy("root").agg(F.min("first").alias("component_id")))
    labels = cut(rooted.select("id", "root").join(least, "root").select("id", "root", "component_id"))
    return made.join(labels, "id").select("doc_id", "text_key", "size", "component_id", F.col("root").alias("component"))


def op6_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("f0"), 16, "0")).alias("fingerprint"), "component_id")
