"""Binary symbol indexes: an encoder of our own, positions by brute force, damaged input, the cache."""

import random

import pytest

from tests.services import write
from weftgraph.plans import analyze, incremental
from weftgraph.sources import symbols


def number(value):
    value &= (1 << 64) - 1
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def piece(field, value):
    return number(field << 3) + number(value) if isinstance(value, int) else number(field << 3 | 2) + number(len(value)) + value


def encoded(docs, packed=True):
    """An index of (path, encoding code, [(span, symbol, roles)]), among fields that a reader does not know."""
    out = piece(1, piece(3, b"file:///x"))
    for path, code, found in docs:
        body = piece(1, path.encode()) + piece(4, b"python") + number(9 << 3 | 5) + b"\0\0\0\0" + number(10 << 3 | 1) + b"\0" * 8
        for span, symbol, roles in found:
            numbers = piece(1, b"".join(map(number, span))) if packed else b"".join(piece(1, n) for n in span)
            body += piece(2, numbers + piece(2, symbol.encode()) + piece(3, roles) + piece(5, 7))
        out += piece(2, body + piece(6, code))
    return out + piece(3, piece(1, b"external"))


@pytest.mark.parametrize("packed", [True, False])
def test_round_trip(packed):
    docs = [("a.py", 2, [([0, 4, 7], "x/f().", 1), ([1, 0, 2, 300], "y#", 0), ([], "z", 8), ([-1, 2, 3], "n", 1)]), ("b.py", 0, [])]
    got = [(p, e, [(o["span"], o["symbol"], o["roles"]) for o in found]) for p, e, found in symbols.documents(encoded(docs, packed))]
    assert got == [("a.py", "utf-16", docs[0][2]), ("b.py", "utf-16", [])]
    assert list(symbols.documents(b"")) == []


@pytest.mark.parametrize("cut", [1, 3, 10])
def test_damaged_indexes_are_errors(cut):
    whole = encoded([("a.py", 1, [([0, 4, 7], "x/f().", 1)])])
    with pytest.raises(symbols.BadIndex):
        list(symbols.documents(whole[:-cut]))
    with pytest.raises(symbols.BadIndex):
        list(symbols.documents(b"\xff" * 11))


def plain(text, line, column, encoding):
    """The byte of a position, character by character."""
    lines = text.split("\n")
    line = max(0, min(line, len(lines) - 1))
    at, units = len("".join(x + "\n" for x in lines[:line]).encode()), 0
    for c in lines[line]:
        if units >= column:
            break
        units += {"utf-8": len(c.encode()), "utf-16": len(c.encode("utf-16-le")) // 2, "utf-32": 1}[encoding]
        at += len(c.encode())
    return at


@pytest.mark.parametrize("encoding", ["utf-8", "utf-16", "utf-32"])
def test_positions_beside_brute_force(encoding):
    dice = random.Random(5)
    for _ in range(200):
        text = "".join(dice.choice("ab\n\r é語😀") for _ in range(dice.randrange(25)))
        lines = symbols.Lines(text.encode())
        for line in range(-1, text.count("\n") + 2):
            for column in range(-1, 14):
                want = plain(text, line, column, encoding)
                got = lines.byte(line, column, encoding)
                if encoding == "utf-8":  # columns are bytes already, within a character too
                    row = text.encode().split(b"\n")[max(0, min(line, text.count("\n")))]
                    want = plain(text, line, 0, encoding) + min(max(column, 0), len(row))
                assert got == want, (text, line, column)


def test_read_and_place(spark, tmp_path):
    source = "é = 1\ndef f():\n    return é\n"
    docs = [("a.py", 2, [([0, 0, 1], "m/é.", 1), ([2, 11, 12], "m/é.", 8), ([1, 4, 2, 12], "m/f().", 3), ([1, 2], "bad", 1), ([99, 0, 5], "late", 0)]), ("gone.py", 2, [([0, 0, 1], "g", 1)])]
    (tmp_path / "one.index").write_bytes(encoded(docs))
    files = spark.createDataFrame([("s", "a.py", source.encode()), ("t", "a.py", b"")], "service string, relpath string, content binary")
    read = symbols.read_indexes(symbols.index_files(spark, {"s": str(tmp_path / "one.index")}))
    rows = symbols.placed(read, files)
    got = {(r.symbol, r.roles, r.start_byte, r.end_byte, r.start_line) for r in rows.where("NOT malformed").collect()}
    assert got == {("m/é.", 1, 0, 2, 1), ("m/é.", 8, 27, 29, 3), ("m/f().", 3, 11, 29, 2), ("late", 0, 30, 30, 4)}
    assert [tuple(r) for r in symbols.reader_stats(read, files, rows).collect()] == [("s", 2, 1, 2, 2, 1)]
    assert {(r.symbol, r.kind) for r in symbols.split_occurrences(rows).collect()} == {("m/é.", "def"), ("m/é.", "ref"), ("m/f().", "def")}
    assert symbols.read_indexes(symbols.index_files(spark, {})).count() == 0


def test_cache_by_tree_hash(tmp_path):
    made = []

    def make(path):
        made.append(path)
        with open(path, "wb") as f:
            f.write(b"x")
        if len(made) == 1:
            raise RuntimeError("stopped")

    with pytest.raises(RuntimeError):
        symbols.cached_index(str(tmp_path / "c"), "s", "abc", make)
    assert list((tmp_path / "c").iterdir()) == []
    path, there = symbols.cached_index(str(tmp_path / "c"), "s", "abc", make)
    assert not there and symbols.cached_index(str(tmp_path / "c"), "s", "abc", make) == (path, True)
    assert symbols.cached_index(str(tmp_path / "c"), "s", "def", make)[1] is False and len(made) == 3


INDEXED = {"m.py": "from n import helper\n\n\ndef run(tool):\n    tool.lift()\n    helper()\n    local()\n\n\ndef local():\n    pass\n", "n.py": "class Tool:\n    def lift(self):\n        pass\n\n\ndef helper():\n    pass\n"}


def test_calls_by_index(spark, tmp_path):
    of = lambda descriptor: f"scheme python pkg 1.0 {descriptor}"
    refs = [([4, 9, 13], of("`n`/Tool#lift()."), 8), ([5, 4, 10], of("`n`/helper()."), 8), ([3, 4, 7], of("`m`/run()."), 1), ([4, 4, 8], "local 3", 8)]
    (tmp_path / "m.index").write_bytes(encoded([("m.py", 0, refs)]))
    services = {name: write(tmp_path / name, INDEXED) for name in ("read", "guessed")}
    graph = analyze.index(spark, services, indexes={"read": str(tmp_path / "m.index")})
    got = {(r.src, r.dst, r.resolution, r.confidence) for r in graph.edges.where("type = 'CALLS'").collect()}
    assert got == {
        ("sym:read:`m`/run().", "sym:read:`n`/Tool#lift().", "static", 1.0),
        ("sym:read:`m`/run().", "sym:read:`n`/helper().", "static", 1.0),
        ("sym:guessed:`m`/run().", "sym:guessed:`n`/helper().", "heuristic", 0.6),
        ("sym:guessed:`m`/run().", "sym:guessed:`m`/local().", "heuristic", 0.6),
    }
    again = incremental.rebuild(incremental.refresh(spark, services, None)[0], None, {"read": str(tmp_path / "m.index")})
    assert {(r.src, r.dst, r.resolution, r.confidence) for r in again.edges.where("type = 'CALLS'").collect()} == got
    assert {r.relpath for r in analyze.scan(spark, services, {"read": ("n.py",)}).where("service = 'read'").collect()} == {"m.py"}
