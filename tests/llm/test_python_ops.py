"""Packing, language ID, HTML, quality, SimHash and substring dedup: brute force, and the odd cases."""

import hashlib
import random
import re
import zlib
from collections import Counter
from html.parser import HTMLParser

import numpy as np
import pytest
import xxhash

from weftgraph.llm import components, html_text, language_id, packing, quality, simhash, substring_dedup

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile("[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 4)))
    shared = [word() for _ in range(40)]
    out = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "one two three"), (5, "a\x1cb\x85c\xa0d e")]
    for i in range(6, 40):
        ws = [word() for _ in range(rng.randint(0, 120))]
        if i % 3 == 0:
            at = rng.randint(0, len(ws))
            ws[at:at] = shared[rng.randint(0, 10) :]
        out.append((i, rng.choice(["\n", " ", "  "]).join(ws)))
    out += [(50, out[20][1]), (51, out[20][1]), (None, out[20][1]), (52, "Long " * 30000 + " ".join(shared)), (7, "again " + " ".join(shared))]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "clash", 1) for i, t in rows], DOCS).withColumnsRenamed({"source": "component_id", "n_chars": "g"})


def test_packing_round_trip(docs, rows):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    coder = Tokenizer.from_file(path)
    got = packing.pack_documents(docs, path, size=64, group_tokens=3000).collect()
    by_doc: dict = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    want = Counter((i, tuple(coder.encode(t or "", add_special_tokens=False).ids + [2])) for i, t in rows)
    for i in {i for i, _ in rows}:
        mine = {k: v for k, v in want.items() if k[0] == i}
        assert sum(r.length for r in by_doc[i]) == sum(len(k[1]) * v for k, v in mine.items())
        for r in by_doc[i]:
            ids = np.frombuffer(r.ids, "<u4").tolist()
            assert len(ids) == r.length and any(r.doc_tokens == len(k[1]) and list(k[1][r.start : r.start + r.length]) == ids for k in mine)
    sequences: dict = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    first = packing.digests(packing.pack_documents(docs, path)).first()
    assert first.ids_crc32 == zlib.crc32(next(r.ids for r in packing.pack_documents(docs, path).collect() if (r.doc_id, r.start, r.sequence_id) == (first.doc_id, first.start, first.sequence_id)))
    assert packing.pack_documents(docs.limit(0), path).count() == 0


def test_first_fit_decreasing():
    rng = random.Random(1)
    lengths = [rng.randint(1, 300) for _ in range(400)]
    bins: list[int] = []
    for n in sorted((x % 100 for x in lengths if x % 100), reverse=True):
        at = next((k for k, used in enumerate(bins) if used + n <= 100), None)
        if at is None:
            bins.append(n)
        else:
            bins[at] += n
    full = sum(x // 100 for x in lengths)
    used: Counter = Counter()
    for _, _, n, sequence, _ in packing.pack(lengths, 100):
        used[sequence] += n
    assert [used[full + k] for k in range(len(bins))] == bins and len(used) == full + len(bins)


def test_word_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "WORD_MEMORY", 3)
    words = packing.Words(packing.default_tokenizer())
    assert not words.whole
    once = words.ids([b"alpha beta", b"gamma Beta delta"])
    assert words.ids([b"alpha beta", b"gamma Beta delta"]) == once and words.ids([b"<|ENDOFTEXT|> x"]) != words.ids([b"<|endoftext|> x"])


def test_word_memory_is_bounded_by_the_caller(spark, monkeypatch):
    import corpus_pipeline

    path, asked = packing.default_tokenizer(), []
    monkeypatch.setattr(packing, "WORKERS", {})
    assert packing.words_for(path).most == packing.WORD_MEMORY
    words = packing.words_for(path, 3)
    once = words.ids([b"alpha beta", b"gamma Beta delta"])
    assert words.ids([b"alpha beta", b"gamma Beta delta"]) == once and len(words.known) <= 3 + 4
    monkeypatch.setattr(packing, "pack_documents", lambda docs, path, **named: asked.append(named) or docs)
    monkeypatch.setattr(packing, "digests", lambda pieces: pieces)
    corpus_pipeline.pack(spark, None, "")
    assert asked == [{"word_memory": corpus_pipeline.WORDS}] and corpus_pipeline.WORDS < packing.WORD_MEMORY


def test_other_tokenizers_are_asked_for_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    symbols = {c: k for k, c in enumerate(["<unk>", *map(chr, range(32, 127)), "e ", "the"])}
    coder = Tokenizer(models.BPE(vocab={**symbols, "th": len(symbols)}, merges=[("e", " "), ("t", "h"), ("th", "e")], unk_token="<unk>"))
    coder.pre_tokenizer = pre_tokenizers.Split(pattern="\n", behavior="isolated")
    coder.save(f"{tmp_path}/other.json")
    words = packing.Words(f"{tmp_path}/other.json")
    text = b"see the The tree "
    assert words.whole and np.frombuffer(words.ids([text])[0], "<u4").tolist() == coder.encode(text.decode()).ids


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    got = language_id.op3_language_id(spark, "/root/testdata/sf0.1").join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and 0.2 < len(held) / len(got) < 0.3
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got)
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.99


def test_language_odd_cases(spark, docs):
    model = language_id.train(docs)
    found, (lang, score, _) = language_id.identify(docs.withColumn("score", docs.g), model)
    assert (lang, score) == ("lang_pred", "score_")
    got = {r.doc_id: (r[lang], r[score]) for r in found.collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "en"
    bare = language_id.train(docs.withColumn("lang", docs.lang.substr(9, 1)).where("false"))
    assert bare is None and {r[lang] for r in language_id.identify(docs, bare)[0].collect()} == {"und"}
    assert language_id.identify(docs.limit(0), model)[0].count() == 0


def test_language_sample_is_bounded(spark):
    docs = spark.createDataFrame([(1, f"text number {k}", "en") for k in range(900)] + [(3, "x" * 200_000, "en"), (5, "ein text", "de")], "doc_id bigint, text string, lang string")
    rows = language_id.training_rows(docs, "doc_id", "text", "lang", 10)
    assert sum(lang == "en" for _, lang in rows) == 10 and max(len(t) for t, _ in rows) < 100


def test_language_scores_against_a_dense_kernel_ridge():
    """The kernel by sets, its square root by the landmarks' matrix and the ridge by its normal equations, all written out."""
    rng = random.Random(6)
    word = {"x": "abcdefg", "y": "defghij", "z": "ghijklm"}
    make = lambda lang: " ".join("".join(rng.choice(word[lang]) for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(3, 20)))
    rows = [(make(lang), lang) for lang in "xyz" for _ in range(30)]
    model = language_id.fit(rows, landmarks=8)
    grams = lambda t: {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    kernel = lambda a, b: len(grams(a) & grams(b)) / np.sqrt(len(grams(a)) * len(grams(b)))
    marks = [t for lang in "xyz" for t in [t for t, other in rows if other == lang][:8]]
    own = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(own)
    root = vectors @ np.diag(1 / np.sqrt(values)) @ vectors.T
    mapped = lambda texts: np.array([[kernel(t, m) for m in marks] for t in texts]) @ root
    train, target = mapped([t for t, _ in rows]), np.array([[1.0 if lang == x else -1.0 for x in "xyz"] for _, lang in rows])
    centre, shift = train.mean(axis=0), target.mean(axis=0)
    weights = np.linalg.solve((train - centre).T @ (train - centre) + language_id.RIDGE * len(rows) * np.eye(len(marks)), (train - centre).T @ (target - shift))
    texts = [make(lang) for lang in "xyz" for _ in range(10)] + ["abc klm", "zzz a"]
    want = (mapped(texts) - centre) @ weights + shift
    got, sure, known = language_id.ridge_values(model, language_id.Grams(model.letters), texts)
    met = set().union(*map(grams, marks))
    assert np.allclose(known[:30], [len(grams(t) & met) / len(grams(t)) for t in texts[:30]])
    assert sure.all() and np.abs(got[:30] - want[:30]).max() < 2e-3 and (got.argmax(axis=1)[:30] == want.argmax(axis=1)[:30]).all()


def test_string_kernel_is_presence_of_grams():
    rows = [("abc abd", "x"), ("zzz yyy", "y"), ("abd abc abc", "x"), ("yyy zzy", "y")]
    model = language_id.fit(rows, landmarks=2)
    grams = language_id.Grams(model.letters)
    text = "ab zab"
    want = {text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)}
    assert len(grams.codes(text)) == len(want) and len(set(grams.codes(text).tolist())) == len(want)
    assert len(grams.codes("12 34")) == 0 and len(grams.codes("жж")) == 2


class Words(HTMLParser):
    def __init__(self):
        super().__init__()
        self.off, self.seen = 0, []

    def handle_starttag(self, tag, attributes):
        self.off += tag in ("head", "script", "style", "template", "noscript", "svg")
        self.seen.append(" ")

    def handle_endtag(self, tag):
        self.off -= tag in ("head", "script", "style", "template", "noscript", "svg") and self.off > 0
        self.seen.append(" ")

    def handle_data(self, data):
        if not self.off:
            self.seen.append(data)


def test_html_words_on_a_table(spark, tiny):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()}
    for r in html_text.op4_html_extraction(spark, tiny).collect():
        other = Words()
        other.feed(pages[r.page_id])
        other.close()
        assert "".join(r.text.split()).replace("-", "") == "".join("".join(other.seen).split()).replace("-", "")


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""), ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\n\nb"), ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>", "- a\n- b\n  3. c\n  4. d"),
        ("<table><tr><th>n<th>qty<tr><td>apple<td>3</table>", "n      qty\napple  3"),
        ("<table><tr><td colspan=2>both<td>x<tr><td>a<td>b<td>y</table>", "both  x\na  b  y"),
        ("<div hidden>x</div><div style='DISPLAY : none'>y</div><p style='visibility:hidden'>z<b style='visibility:visible'>w</b></p>", "w"),
        ("<script>if (a<b) '</p>'</script>x<style>p{}</style><!-- c -->y", "xy"), ("<pre>a  b\n  c</pre>", "a  b\n  c"),
        ("<details>x<summary>s</summary></details><details open>x</details>", "s\nx"), ("a &amp; b&nbsp;&nbsp;c &lt;p&gt;", "a & b  c <p>"),
        ("<title>t</title><p>x</div></span>y<b", "xy"), ("<td>loose", "loose"), ("3 < 4 and <3", "3 < 4 and <3"), ("<p a='x>y\">b</p>c", 'y">b\n\nc'),
    ],
)
def test_html_layout(html, text):
    assert html_text.visible_text(html) == text


def test_html_deep_and_hostile():
    assert html_text.visible_text("<div>" * 20000 + "x") == "x"
    assert html_text.visible_text("<table><tr><td>" * 300 + "x").strip() == "x"
    assert html_text.visible_text("<a b=\"" * 20000) is not None


@pytest.mark.parametrize("part", ["<div>", "<p><table><td><div>", "<div></p>", "<ul><li>x", "<b><i>", "<p>", "<table><tr><td rowspan=9 colspan=9>", "</table></div>", "<table><td><p><div></p>"])
def test_html_takes_time_in_proportion(part):
    import time

    began = time.time()
    html_text.parse("<p>" + part * (1_000_000 // len(part)) + "x")
    assert time.time() - began < 12
    if "<table>" not in part:
        assert html_text.visible_text(part * 20000 + "end").endswith("end")


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("<table><tr><td rowspan=2>A<td>B<td>C<tr><td>D<td>E</table>", "A  B  C\n   D  E"),
        ("<table><tr><td>a<td rowspan=0>down<td>b<tr><td>c<td>d<tr><td>e<td>f</table>", "a  down  b\nc        d\ne        f"),
        ("<table><tr><td rowspan=2 colspan=2>wide<td>x<tr><td>y<tr><td>p<td>q<td>r</table>", "wide  x\n      y\np  q  r"),
        ("<table><caption>title<tr><th>k<th>v<tr><td>long one<td>1</table>after", "title\nk         v\nlong one  1\n\nafter"),
    ],
)
def test_html_tables(html, text):
    assert html_text.visible_text(html) == text


def test_html_table_columns_stand_under_each_other():
    """Random grids of cells that span rows and columns: texts in reading order, one start for each column."""
    rng = random.Random(8)
    for _ in range(200):
        n_rows, n_columns = rng.randint(1, 6), rng.randint(1, 6)
        taken, where, html = set(), {}, "<table>"
        for r in range(n_rows):
            html += "<tr>"
            for c in range(n_columns):
                if (r, c) in taken:
                    continue
                across, below = rng.choice([1, 1, 1, 2]), rng.choice([1, 1, 1, 2, 3])
                if any((r, c + x) in taken or c + x >= n_columns for x in range(across)):
                    across = 1
                taken |= {(r + y, c + x) for x in range(across) for y in range(below)}
                name = f"r{r}c{c}" + "z" * rng.randint(0, 5) if across == 1 else f"r{r}c{c}"
                where[name] = c, across
                html += f"<td colspan={across} rowspan={below}>{name}"
        lines = html_text.visible_text(html + "</table>").split("\n")
        assert [w for line in lines for w in line.split()] == list(where)
        starts: dict = {}
        for line in lines:
            for m in re.finditer(r"\S+", line):
                starts.setdefault(where[m[0]][0], set()).add(m.start())
        singles = {c for c, across in where.values() if across == 1}
        if len(singles) == n_columns:
            assert all(len(x) == 1 for x in starts.values()) or any(across > 1 for _, across in where.values())


def measures(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    often = Counter(windows)
    again = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(again)


def test_quality_against_brute_force(spark, docs, rows):
    extra = [(60, "w x y z " * 30), (61, "###a " * 40), (62, "Good words stand here in a row. " * 2 + "and then some more that differ from all " * 1), (63, "SHOUT " + "LOUD MORE TEXT " * 2)]
    more = spark.createDataFrame([(i, t) for i, t in rows + extra], "doc_id bigint, text string")
    got = sorted(((r.doc_id or 0, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.filter_quality(more).collect()))
    assert got == sorted((i or 0, *measures(t)) for i, t in rows + extra)
    verdict = {r.doc_id: (r.base_failed, r.kept) for r in quality.filter_quality(more).collect()}
    assert verdict[60] == (True, False) and verdict[61][1] is False and verdict[1] == (True, False)
    assert quality.filter_quality(docs.limit(0)).count() == 0


GOOD = " ".join(f"plain{k} words stand here in number{k}" for k in range(12)).replace("0", "o")


@pytest.mark.parametrize(
    ("text", "rule"),
    [
        (GOOD, None), (GOOD + " # $" * 20, "symbols"), ("ab " * 3 + " ".join(chr(97 + k % 26) + chr(97 + k // 26) for k in range(300))[:170].replace(" ", " a ") + " b c d e f g", "word_length"),
        ("\n".join(["one same line stands here", GOOD] + ["one same line stands here"] * 4), "repeated_lines"), (GOOD + "!" * 60, "exclamations"), (GOOD.upper(), "capitals"),
        (GOOD + " 1234567890" * 12, "digits"), (GOOD + " 12-34 (5)" * 20, "no_letters"), (" the ".join(GOOD.split()), "one_word"), ("\n".join("- " + x for x in GOOD.split("here")), "bullets"),
        ("\n".join(x + "...  " for x in GOOD.split("here")), "ellipses"), (GOOD + " Lorem IPSUM", "placeholder"), (GOOD + " {}" * 2, "code"), (GOOD + " \ufffd", "broken"),
    ],
)
def test_quality_rules(text, rule):
    t = quality.Text(text.encode())
    rejecting = {name for name, rejects in quality.RULES.items() if rejects(t)}
    assert rule is None and not rejecting or rule in rejecting


def test_cascade_runs_the_most_rejecting_cheap_rule_first():
    texts = lambda: [quality.Text(b"x y z %d" % k) for k in range(50)]
    rules = {"never": lambda t: False, "slow": lambda t: sum(range(20000)) > 0, "fast": lambda t: t.n_words > 0}
    assert quality.cascade_order(texts(), rules)[0] == "fast"
    # a rule is not charged for basic measures, nor for what a rule before it has counted
    costly = lambda t: t.__dict__.setdefault("costly", sum(range(20000))) > 0
    half = {"a_first": lambda t: costly(t) and int(t.words[-1]) % 10 < 8, "b_shares": lambda t: costly(t) and int(t.words[-1]) % 2 == 0, "c_own": lambda t: sum(range(4000)) > 0 and int(t.words[-1]) % 2 == 1 and int(t.words[-1]) < 2}
    assert quality.cascade_order(texts(), half)[:2] == ["a_first", "b_shares"]


def test_cascade_order_does_not_reach_the_verdict(monkeypatch):
    import pyarrow as pa

    rng = random.Random(2)
    pool = [GOOD, GOOD.upper(), GOOD + "!" * 60, GOOD + " {}" * 3, "short", GOOD + " # $" * 20]
    texts = [rng.choice(pool).encode() for _ in range(600)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(600), pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "text"])
    want = [not quality.Text(t).base_failed and not any(r(quality.Text(t)) for r in quality.RULES.values()) for t in texts]
    for rows in (1, 20, 10_000):
        monkeypatch.setattr(quality, "SAMPLE_ROWS", rows)
        assert [k for b in quality.judge()([batch]) for k in b.column("kept").to_pylist()] == want


def brute_print(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    parts = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_against_brute_force(docs, rows):
    prints = [brute_print(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for (i, _), g in zip(rows, group, strict=True):
        if i is not None:
            least[g] = min(i, least.get(g, i))
    want = sorted(((i or 0, p, least.get(g)) for (i, _), p, g in zip(rows, prints, group, strict=True)), key=repr)
    got = sorted(((r.doc_id or 0, r.f0 % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect()), key=repr)
    assert got == want
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize(("words", "radius", "lanes", "step", "ratio"), [(1, 2, 4, 1, 0.0), (1, 5, 2, 3, 0.0), (4, 48, 1, 32, 0.8)])
def test_no_link_is_lost_between_tiles(spark, monkeypatch, words, radius, lanes, step, ratio):
    monkeypatch.setattr(simhash, "TILE", 40)
    rng = np.random.default_rng(2)
    prints = rng.integers(0, 2**63, (120, words))
    near = np.repeat(prints, 4, axis=0)
    for row in near:
        for b in rng.integers(0, 64 * words, radius // 2 + 1):
            row[b // 64] ^= np.int64(1) << np.int64(b % 64) if b % 64 < 63 else np.int64(0)
    prints = np.concatenate([prints, near])
    sizes = rng.integers(1, 100, len(prints))
    nodes = spark.createDataFrame([(k, int(s), *map(int, p)) for k, (s, p) in enumerate(zip(sizes, prints, strict=True))], "id bigint, size bigint, " + ", ".join(f"f{k} bigint" for k in range(words)))
    found = components.roots(simhash.links(nodes, words, radius, lanes, step, ratio)).collect()
    label = {r.u: r.root for r in found}
    group = list(range(len(prints)))
    bits = prints.view(np.uint64)
    for i in range(len(prints)):
        for j in range(i):
            if np.bitwise_count(bits[i] ^ bits[j]).sum() <= radius and min(sizes[i], sizes[j]) >= ratio * max(sizes[i], sizes[j]):
                a, b = group[i], group[j]
                group = [min(a, b) if g in (a, b) else g for g in group]
    assert [label.get(k, k) for k in range(len(prints))] == group


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 30)] + [(500, 500), (600, 599), (599, 600)]
    got = {r.u: r.root for r in components.roots(spark.createDataFrame(edges, "u bigint, v bigint")).collect()}
    assert got == {**{i: 100 for i in range(101, 161)}, **{i: 0 for i in range(1, 30)}, 600: 599}


def test_cover_meets_every_pair_of_positions():
    p = substring_dedup.PERIOD
    assert all(any((i + s) % p in substring_dedup.COVER and (j + s) % p in substring_dedup.COVER for s in range(p)) for i in range(p) for j in range(p))


@pytest.mark.parametrize("small", [False, True])
def test_substrings_against_brute_force(docs, rows, monkeypatch, small):
    if small:  # many groups and buckets
        monkeypatch.setattr(substring_dedup, "GROUP_BYTES", 5000)
        monkeypatch.setattr(substring_dedup, "BUCKET_HASHES", 100)
    first: dict = {}
    for i, t in rows:
        words = WORD.findall(t or "")
        for k in range(len(words) - 12) if i is not None else ():
            key = tuple(words[k : k + 13])
            first[key] = min(i, first.get(key, i))
    want = []
    for i, t in rows:
        words = WORD.findall(t or "")
        gone = {k + d for k in range(len(words) - 12) if i is not None and first[tuple(words[k : k + 13])] < i for d in range(13)}
        kept = " ".join(w for k, w in enumerate(words) if k not in gone)
        want.append((i or 0, len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = [(r.doc_id or 0, r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in substring_dedup.dedup_substrings(docs).collect()]
    assert sorted(got) == sorted(want) and sum(w[2] for w in want) > 100
    assert substring_dedup.dedup_substrings(docs.limit(0)).count() == 0


def test_substring_groups_do_not_grow_with_the_corpus(spark):
    """Rows of one id and text are dealt to many groups, and a group's memory stays small."""
    import tracemalloc

    import pyarrow as pa

    text = " ".join(f"w{k}" for k in range(400))
    docs = spark.createDataFrame([(1, text)] * 3000, "doc_id bigint, text string")
    groups = substring_dedup.deal(docs, 4).groupBy("g").count().collect()
    assert len(groups) == 4 and max(r["count"] for r in groups) < 1000
    rng = random.Random(1)
    size = substring_dedup.GROUP_BYTES
    texts = [" ".join(f"x{rng.randrange(10**6)}" for _ in range(300)).encode() for _ in range(size // 2300)]
    table = pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.binary()), "g": pa.array([0] * len(texts), pa.int64())})
    tracemalloc.start()
    substring_dedup.send_anchors(4)(table)
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()
