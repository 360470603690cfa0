"""Every stage on small planted documents, and the whole run on a table."""

import numpy as np

import corpus_pipeline as pipeline
from weftgraph.llm import packing

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, component_id string, n bigint"
STAGES = dict(pipeline.STAGES)
ENGLISH = [" ".join(f"the word{k}x{j} stands with others{j * k % 7}" for j in range(30)) for k in range(20)]
GERMAN = [" ".join(f"das wort{k}y{j} steht mit anderen{j * k % 5}" for j in range(30)) for k in range(20)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, None, None, "x", 1) for i, t, lang in rows], DOCS)


def rows():
    return [(k, t, "en") for k, t in enumerate(ENGLISH)] + [(100 + k, t, "de") for k, t in enumerate(GERMAN)]


def kept(df):
    return sorted((r.doc_id for r in df.collect()), key=str)


def test_language_keeps_clean_documents(spark):
    docs = frame(spark, rows() + [(500, "12 34", None), (501, None, "en"), (None, ENGLISH[0], None)])
    out = STAGES["language_id"](spark, docs, "")
    assert kept(out) == sorted([i for i, *_ in rows()] + [None], key=str) and out.columns == docs.columns


def test_language_rejects_what_it_has_not_learned(spark):
    """Whatever the number of languages: a text in none of them goes, one too short to tell stays."""
    foreign = "\u0412\u0441\u0435 \u043b\u044e\u0434\u0438 \u0440\u043e\u0436\u0434\u0430\u044e\u0442\u0441\u044f \u0441\u0432\u043e\u0431\u043e\u0434\u043d\u044b\u043c\u0438 " * 5
    third = [(200 + k, t.replace("the", "los").replace("stands", "quedan").replace("others", "otras"), "es") for k, t in enumerate(ENGLISH)]
    for given in (rows()[:20], rows(), rows() + third):
        docs = frame(spark, given + [(800, foreign, None), (801, "\u0432\u0441\u0435", None)])
        assert sorted(kept(STAGES["language_id"](spark, docs, ""))) == sorted([i for i, *_ in given] + [801])


def test_near_duplicates(spark):
    near = ENGLISH[3].replace("word3x20", "other")
    far = " ".join(f"quite unlike{j}" for j in range(60))
    docs = frame(spark, rows() + [(600, ENGLISH[3], "en"), (601, near, "en"), (602, far, "en"), (602, far, "en"), (None, ENGLISH[3], "en"), (700, None, None), (701, "", None)])
    out = STAGES["simhash_near_dedup"](spark, docs, "")
    assert kept(out) == sorted([i for i, *_ in rows()] + [602, 700, None], key=str) and out.columns == docs.columns
    assert out.where("doc_id = 602").count() == 1


def test_leaks_and_secrets(spark, tmp_path):
    item = " ".join(f"item{i}" for i in range(25))
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = frame(spark, [(1, f"a {item} b", "en"), (None, item, "en"), (2, "clean text", "en"), (3, None, "en")])
    out = STAGES["decontamination"](spark, docs, str(tmp_path))
    assert kept(out) == [2, 3] and out.columns == docs.columns
    secret = frame(spark, [(1, "é password: hunter2hunter2, bye", "en"), (2, "clean text", "en"), (3, None, "en")])
    out = STAGES["secret_scan"](spark, secret, "")
    assert {r.doc_id: r.text for r in out.collect()} == {1: "é [SECRET], bye", 2: "clean text", 3: None} and out.columns == secret.columns


def test_empty_tables_pass(spark, tiny):
    docs = frame(spark, rows()).limit(0)
    for _, stage in pipeline.STAGES:
        out = stage(spark, docs, tiny)
        assert out.count() == 0


def test_run_keeps_every_token_of_what_is_left(spark, tiny):
    got = pipeline.run(spark, tiny).collect()
    total = {}
    for r in got:
        total.setdefault(r.doc_id, []).append((r.start, r.length, r.doc_tokens))
    for parts in total.values():
        assert sum(n for _, n, _ in parts) == parts[0][2]
    documents = spark.read.parquet(f"{tiny}/documents.parquet").count()
    assert 0.5 * documents < len(total) < documents
    assert packing.SEQUENCE >= max(np.bincount(np.unique([r.sequence_id for r in got], return_inverse=True)[1], [r.length for r in got]))


def test_near_duplicates_are_confirmed_by_their_shingles(spark):
    """Small texts and pairs at the threshold: linked are exactly those of Jaccard similarity 0.8."""
    rng = np.random.default_rng(4)
    texts = []
    for n in [*range(8, 16), 20, 24, 40, 70, 90, 130, 220]:
        for _ in range(6):
            words = [f"v{x}" for x in rng.integers(0, 10**9, n)]
            cut = lambda k: " ".join(words[: len(words) - k])  # noqa: B023, E731
            texts += [" ".join(words), cut(1), cut(max(2, (n - 4) // 5)), " ".join([*words[:-1], "end"]), " ".join([*words[: n // 2], "mid", *words[n // 2 + 1 :]])]
    rows = [(k, t, "en") for k, t in enumerate(texts)]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (t.split() for t in texts)]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
                old, new = max(root[i], root[j]), min(root[i], root[j])
                root = [new if r == old else r for r in root]
    out = STAGES["simhash_near_dedup"](spark, frame(spark, rows), "")
    assert kept(out) == sorted({str(r): r for r in root}.values(), key=str)


def test_large_candidate_groups_are_compared_in_parts(spark, monkeypatch):
    monkeypatch.setattr(pipeline.simhash, "PART", 3)
    words = [f"w{k}" for k in range(120)]
    chain = [" ".join(words[k : k + 100]) for k in range(0, 20, 2)]
    other = [" ".join(words[:58] + [f"o{k}x{j}" for j in range(40)]) for k in range(3)]
    docs = frame(spark, [(k, t, "en") for k, t in enumerate(chain + other)])
    assert kept(STAGES["simhash_near_dedup"](spark, docs, "")) == sorted([0, 10, 11, 12], key=str)


def test_near_duplicates_of_one_id_and_unlike_texts_all_stay(spark):
    docs = frame(spark, [(1, ENGLISH[0], "en"), (1, GERMAN[0], "de"), (1, GERMAN[0], "de"), (2, GERMAN[1], "de"), (3, GERMAN[0], "en")])
    out = STAGES["simhash_near_dedup"](spark, docs, "")
    assert sorted((r.doc_id, r.text) for r in out.collect()) == sorted([(1, ENGLISH[0]), (1, GERMAN[0]), (2, GERMAN[1])])


def test_large_groups_are_compared_across_tiles(spark, monkeypatch):
    """Groups of many tiles: near copies, chains of them, and texts that only share a band key."""
    monkeypatch.setattr(pipeline.simhash, "PART", 8)
    rng = np.random.default_rng(7)
    texts = []
    for _ in range(3):
        words = [f"u{x}" for x in rng.integers(0, 10**9, 160)]
        for _ in range(40):
            mine = list(words)
            for at in rng.integers(0, 160, int(rng.integers(0, 9))):
                mine[at] = f"n{rng.integers(10**9)}"
            texts.append(" ".join(mine[: int(rng.integers(110, 161))]))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) and root[i] != root[j]:
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    out = STAGES["simhash_near_dedup"](spark, frame(spark, [(k, t, "en") for k, t in enumerate(texts)]), "")
    assert kept(out) == sorted(set(root), key=str) and len(set(root)) > 6
