"""Whole results on inputs where an earlier form ran out of time, memory or exactness."""

from pyspark.sql import functions as F

from tests.test_traversal import made


def fan(spark, producers=6, consumers=9):
    """Producers of events in two topics, some consumers of both and of the events, and one that is both ends."""
    mark = lambda n: ("", "", ("static", "heuristic")[n % 2], (1.0, 0.8, 0.6, 0.4)[n % 4])
    rows = [(t, f"chan:E{n}", "CONTAINS") for n in range(4) for t in ("chan:T1", "chan:T2")[: 1 + n % 2]]
    rows += [(f"x{p}", f"chan:E{e}", "PRODUCES", *mark(p + e + again)) for p in range(producers) for e in range(4) for again in range(2)]
    rows += [(f"{'x' if c == 0 else 'y'}{c}", f"chan:T{1 + (c + t) % 2}", "CONSUMES", *mark(c + 2 * t)) for c in range(consumers) for t in range(1 + c % 2)]
    rows += [(f"y{c}", f"chan:E{c % 4}", "CONSUMES", *mark(c + 1)) for c in range(consumers + 3)]
    return made(spark, rows)


def brute(rows):
    """src, dst, channel: (resolution, confidence), pair by pair."""
    rows = [(r.src, r.dst, r.type, r.resolution, r.confidence) for r in rows]
    consumed = [(s, d, 0, r, c) for s, d, t, r, c in rows if t == "CONSUMES"]
    consumed += [(s, e, 1, r, c) for s, d, t, r, c in rows if t == "CONSUMES" for top, e, kind, *_ in rows if kind == "CONTAINS" and top == d]
    best = {}
    for x, ch, t, rx, cx in rows:
        for y, of, turn, ry, cy in consumed:
            if t == "PRODUCES" and of == ch and x != y:
                new = (turn, rx == ry == "static", round(cx * cy, 6))
                best[x, y, ch] = max(best.get((x, y, ch), new), new)
    return {k: ("static" if s else "heuristic", c) for k, (_, s, c) in best.items()}


def test_pairs_of_a_topic_are_streamed(spark):
    from weftgraph.operators import link

    e = fan(spark)
    got = link.next_segments(e)
    found = got.collect()
    assert {(r.src, r.dst, r.via_channel): (r.resolution, r.confidence) for r in found} == brute(e.collect()) and len(found) == len(brute(e.collect()))
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("Join")]


def test_owners_meet_consumers_without_pairs(spark):
    from weftgraph.operators import link

    e = fan(spark)
    owners = {f"x{p}": f"o{p % 3}" for p in range(6)}
    got = link.next_of_owners(e, spark.createDataFrame(list(owners.items()), "node string, owner string")).collect()
    assert sorted((r.owner, r.next) for r in got) == sorted({(owners[x], y) for x, y, _ in brute(e.collect())})
    alone = made(spark, [("x", "E", "PRODUCES"), ("x", "E", "CONSUMES")])
    assert link.next_of_owners(alone, spark.createDataFrame([("x", "o")], "node string, owner string")).isEmpty()


def test_onward_lists(spark):
    from weftgraph.operators import link

    e = fan(spark)
    exits = e.where("type = 'PRODUCES'").select(F.col("src").alias("producer"), F.col("dst").alias("channel"))
    exits = exits.unionByName(spark.createDataFrame([("z", "chan:none")], exits.schema))
    want = {(r.producer, r.channel): [] for r in exits.collect()}
    for (x, y, ch), (_, c) in sorted(brute(e.collect()).items()):
        if c >= 0.5:
            want[x, ch].append(y)
    got = link.onward(e, exits, 0.5).collect()
    assert {(r.producer, r.channel): r.next_ids for r in got} == want and len(got) == len(want)


def test_unique_match_counts_before_it_joins(spark):
    from weftgraph.operators import link

    left = spark.createDataFrame([(1, 7), (2, 8), (3, 9), (4, None)], "id long, size int")
    right = spark.createDataFrame([(7, "a"), (8, "b"), (8, "c"), (None, "d")], "size int, supplier string")
    got = link.unique_match(left, right, ["size"], "id", ["supplier"]).collect()
    assert {r.id: r.supplier for r in got} == {1: "a", 2: None, 3: None, 4: None}


def against_sql(spark, folder, name):
    from compare import canonical, oracle_rows
    from weftgraph.plans import catalogue

    df = catalogue.QUERIES[name](spark, str(folder))
    return canonical(df.columns, [tuple(r) for r in df.collect()]) == canonical(*oracle_rows(str(folder), catalogue.ORACLE_SQL[name]))


def test_blanks_are_those_of_the_sql(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    texts = [f"{a}{c}x {c} y{c}{a}" for c in "\x0b\x0c\u00a0\u2003\u3000\u0085\t\n\r" for a in ("", " ", "\n")] + ["\n\nlead", "  a\nb", "tail \nz", "", "q" * 130]
    pq.write_table(pa.table({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": texts}), f"{tmp_path}/documents.parquet")
    assert all(against_sql(spark, tmp_path, name) for name in ("h24_one_line", "h11_sanitize", "h5_slugify"))


def test_embedder_keeps_doubles(spark):
    import pyarrow as pa

    from weftgraph.operators import chunks

    batch = pa.RecordBatch.from_arrays([pa.array(["a"]), pa.array(["text"])], names=["a", "b"])
    assert next(iter(chunks.hash_embedder(8)([batch]))).column(1).type == pa.list_(pa.float64())


def test_bags_keep_only_what_is_asked(spark, monkeypatch):
    from weftgraph.operators import search

    docs = spark.createDataFrame([(n, ("b a c b", "a b b x", "z")[n % 3]) for n in range(30)] + [(30, " ")], "id long, text string")
    asked = spark.createDataFrame([(q, ("a b", "b, a", "z nosuch", "")[q % 4]) for q in range(8)], "question long, text string")
    wanted = spark.createDataFrame([("a",), ("b",)], "token string")
    for most in (5000, 1):
        monkeypatch.setattr(search, "MOST_LISTED", most)
        got = search.bags(search.postings(docs, "id", F.col("text")), wanted).collect()
        assert sorted((r.id, r.dl, r.bag) for r in got) == [(n, *((4, "<a><b><b>"), (4, "<a><b><b>"), (1, ""))[n % 3]) for n in range(30)]
        found = search.search_text(search.postings(docs, "id", F.col("text")), asked, 3).collect()
        assert {(r.question, r["rank"]): r.id for r in found} == {(q, n): ((0, 1, 3), (0, 1, 3), (2, 5, 8))[q % 4][n] for q in range(8) if q % 4 < 3 for n in range(3)}


def test_questions_of_one_set_are_one(spark):
    from weftgraph.operators import search

    asked = spark.createDataFrame([(1, "b a"), (2, "a-b"), (3, "-")], "question long, text string")
    assert {r.question: sorted(r.ts) for r in search.question_sets(asked).collect()} == {1: ["a", "b"], 2: ["a", "b"]}


def test_sets_of_tokens_are_in_the_plan(spark, monkeypatch):
    from weftgraph.operators import search

    docs = spark.createDataFrame([(1, "a b"), (2, "a"), (3, "a a c"), (4, "c"), (5, "z")], "id long, text string")
    asked = spark.createDataFrame([(1, "b a"), (2, "a-b"), (3, "c nosuch"), (4, "nosuch"), (5, "")], "question long, text string")
    written, cut = [], search.cut
    monkeypatch.setattr(search, "cut", lambda df: written.append(df.columns) or cut(df))
    for bound, value, tables in (("MOST_SETS", 10_000, 4), ("MOST_SETS", 1, 5), ("LONGEST_SET", 2, 5)):
        with monkeypatch.context() as m:
            m.setattr(search, bound, value)
            found = search.search_text(search.postings(docs, "id", F.col("text")), asked, 2).collect()
            assert sorted((r.question, r["rank"], r.id) for r in found) == [(1, 0, 1), (2, 0, 1), (3, 0, 4), (3, 1, 3)]
            assert len(written) == tables
            written.clear()


def test_postings_write_nothing(spark):
    from weftgraph.operators import search

    docs = spark.createDataFrame([(1, "a b")], "id long, text string")
    assert [(r.id, r.ts) for r in search.postings(docs, "id", F.col("text")).frame.collect()] == [(1, ["a", "b"])]


def test_tokens_are_taken_out_and_not_split(spark):
    from weftgraph.operators import search

    texts = ["", " ", "a", "-a--B_c 1\n\t", "\u212aelvin \u0130x \u00e9t\u00e9 na\u00efve", "x" * 50, "\u4e2d\u6587 a\U0001f600b", None]
    got = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "id int, text string").select("id", "text", search.tokens(F.col("text")).alias("ts"))
    apart = F.filter(F.split(F.lower("text"), "[^a-z0-9_]+"), lambda t: t != "")
    assert got.where(~F.col("ts").eqNullSafe(apart)).isEmpty()
    assert "split(" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_a_bag_is_read_once_for_all_its_tokens(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from weftgraph.operators import search

    texts = ["a " * 200_000 + "b", "ab a a1 a_ b", "a ab ab b b b", "b", ""]
    pq.write_table(pa.table({"p_partkey": pa.array(range(0, 20 * len(texts), 20), pa.int64()), "p_name": texts}), f"{tmp_path}/part.parquet")
    assert all(against_sql(spark, tmp_path, name) for name in ("m1_search_symbols", "m2_two_pass"))
    p = spark.createDataFrame([(1, "a b a"), (2, "b")], "id long, text string")
    found = search.search_text(search.postings(p, "id", F.col("text")), spark.createDataFrame([(1, "a b")], "question long, text string"), 3)
    assert [r.id for r in found.collect()] == [1]


def test_vectors_send_rows_of_a_bounded_number_of_tasks(spark, monkeypatch):
    import math
    import random

    from weftgraph.operators import search

    draw = random.Random(3)
    rows = [(n, [float(draw.randint(-1, 1)) for _ in range(3)]) for n in range(900)] + [(900, None), (901, [1.0])]
    asked = [(q, [float(draw.randint(-1, 1)), 1.0, 0.5]) for q in range(40)]

    def distance(a, b):
        norms = math.hypot(*a) * math.hypot(*b)
        return round(1 - sum(x * y for x, y in zip(a, b, strict=True)) / norms, 6) if norms else math.inf

    want = {(q, n): i for q, a in asked for n, (_, i) in enumerate(sorted((distance(a, v), i) for i, v in rows[:900])[:4])}
    vectors = spark.createDataFrame(rows, "id long, vector array<double>").repartition(100, "id")
    questions = spark.createDataFrame(asked, "question long, vector array<double>")
    sent, top = [], search.top
    monkeypatch.setattr(search, "top", lambda df, *a: sent.append(df) or top(df, *a))
    most = max(12, spark.sparkContext.defaultParallelism)
    monkeypatch.setattr(search, "BLOCK", 7, raising=False)
    monkeypatch.setattr(search, "SLICE", 5, raising=False)
    for held in (128 << 20, 1000):  # of few bytes: several portions of the questions
        monkeypatch.setattr(search, "MOST_HELD", held, raising=False)
        assert {(r.question, r["rank"]): r.id for r in search.search_vectors(vectors, questions, 4).collect()} == want
        assert sent.pop().count() <= most * 40 * 4
    # what has no distance comes last and takes no place
    few = spark.createDataFrame([(n, [0.0, 0.0]) for n in range(5)] + [(9, [1.0, 0.0])], "id long, vector array<double>").coalesce(1)
    found = search.search_vectors(few, spark.createDataFrame([(1, [1.0, 0.0])], "question long, vector array<double>"), 2).collect()
    assert [r.id for r in sorted(found, key=lambda r: r["rank"])] == [9, 0]


def test_rows_of_a_key_meet_in_bounded_portions(spark, tmp_path, monkeypatch):
    from weftgraph import session
    from weftgraph.operators import dedup

    spark.range(40_000, numPartitions=8).select((F.col("id") % 2).alias("k"), "id").write.parquet(f"{tmp_path}/t")
    monkeypatch.setattr(session, "PORTION", 4 << 10)
    df = spark.read.parquet(f"{tmp_path}/t")
    dealt = session.spread(df, ["k"])
    held = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert dealt.rdd.getNumPartitions() > 16 and sum(held) == 40_000 and max(held) < 20_000
    first = dedup.first_rows(df, ["k"], [F.col("id")])
    assert sorted(tuple(r) for r in first.collect()) == [(0, 0), (1, 1)]
    plan = first._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate") < plan.index("RepartitionByExpression")


def test_sets_are_compared_in_one_pass(spark):
    from weftgraph.operators import evaluate

    rows = lambda *r: spark.createDataFrame(r, "type string, src string, dst string")
    found = rows(("t", "a", "b"), ("t", "a", "b"), ("t", "a", None), ("u", "a", "b"), (None, "a", "b"))
    golden = rows(("t", "a", "b"), ("t", "c", "b"), ("t", "a", None), ("v", "a", "b"), (None, "a", "b"))
    got = evaluate.precision_recall(found, golden, ["src", "dst"], ["type"])
    assert {r.type: (r.n_found, r.n_golden, r.hits) for r in got.collect()} == {"t": (2, 3, 1), "u": (1, 0, 0), "v": (0, 1, 0), None: (1, 1, 0)}
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_ends_are_dealt_before_they_are_distinct(spark):
    from weftgraph.operators import evaluate

    edges = spark.createDataFrame([("a", "b", "CALLS"), ("a", "b", "CALLS"), ("a", "x", "CALLS")], "src string, dst string, type string")
    nodes = spark.createDataFrame([("a", "s", "A"), ("b", "s", "B")], "id string, service string, qualified_name string")
    found, dangling = evaluate.found_edges(edges, nodes, ["CALLS"])
    assert [tuple(r) for r in found.collect()] == [("s", "A", "s", "B", "CALLS")] and dangling.first().dangling == 1
    assert found._jdf.queryExecution().optimizedPlan().toString().count("RepartitionByExpression") == 2


def read_by(monkeypatch, module, folder):
    """A list that grows by each frame that is written by ``cut`` of ``module`` and reads files of ``folder``."""
    found, real = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df: (found.append(df) if any(str(folder) in f for f in df.inputFiles()) else None, real(df))[1])
    return found


def test_levels_of_a_climb_do_not_read_the_graph_again(spark, tmp_path, monkeypatch):
    from weftgraph.operators import graph

    made(spark, [(f"n{k}", f"n{k + 1}", "CALLS") for k in range(6)] + [("z", "n3", "CALLS"), ("y1", "y2", "CALLS"), ("y2", "y1", "CALLS")]).write.parquet(f"{tmp_path}/e")
    spark.createDataFrame([("n1",), ("q",)], "id string").write.parquet(f"{tmp_path}/s")
    starts = spark.createDataFrame([("n6",), ("n1",), ("n0",), ("y1",), ("q",), ("w",)], "id string")
    read = read_by(monkeypatch, graph, tmp_path)
    got = graph.climb(spark.read.parquet(f"{tmp_path}/e"), starts, spark.read.parquet(f"{tmp_path}/s")).collect()
    assert {r.start: r.top for r in got} == {"n6": "n1", "n1": "n1", "n0": "n0", "y1": "y2", "q": "q", "w": "w"} and len(read) == 1


def test_levels_of_a_process_do_not_read_the_graph_again(spark, tmp_path, monkeypatch):
    from weftgraph import session
    from weftgraph.operators import link

    made(spark, [(f"n{k}", f"n{k + 1}", "CALLS") for k in range(6)]).write.parquet(f"{tmp_path}/e")
    declared = spark.createDataFrame([("p", "n0")], "process string, entry string")
    read = read_by(monkeypatch, session, tmp_path)
    got = link.part_of_process(spark.read.parquet(f"{tmp_path}/e"), declared, 4).collect()
    assert sorted((r.node, r.order) for r in got) == [(f"n{k}", k) for k in range(4)] and len(read) == 1


def test_a_text_is_moved_once_for_its_header(spark):
    from weftgraph.operators import chunks

    docs = spark.createDataFrame([(str(n), "s", None if n == 3 else f"f{n % 2}", f"t{n}") for n in range(4)], "symbol_id string, service string, relpath string, text string")
    own = spark.createDataFrame([("1", "C1", "Class", ["r"], None, " \n d \nx"), ("3", "C3", "Class", [], "m", None)], "symbol_id string, qualified_name string, kind string, roles array<string>, parent string, doc string")
    named = lambda key, rows: spark.createDataFrame(rows, f"{key}, name string")
    got = chunks.headers(docs, own, named("service string, relpath string", [("s", "f1", "b"), ("s", "f1", "a"), ("s", "f0", "z")]), named("symbol_id string", [("1", "c"), ("0", "z")]))
    assert {r.symbol_id: r.context_header for r in got.collect()} == {
        "0": "file: f0 · service: s\nsymbol: 0",
        "1": "file: f1 · service: s\nsymbol: C1 (Class, r)\nimports: a, b\ndoc: d \ncalls: c",
        "2": "file: f0 · service: s\nsymbol: 2",
        "3": "symbol: C3 (Class) in m",
    }
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_paths_meet_from_both_ends(spark, monkeypatch):
    from weftgraph.operators import graph

    rows = [("hub", f"m{n}", "CONTAINS") for n in range(40)] + [(f"m{n}", f"leaf{n}-{k}", "CONTAINS") for n in range(40) for k in range(10)]
    pairs = spark.createDataFrame([(f"leaf{n}-{k}", "hub") for n in range(40) for k in range(10)] + [("hub", "hub"), ("hub", "none"), ("leaf0-1", "leaf0-2"), ("leaf0-1", "leaf1-1")], "start string, goal string")
    held, kept = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: held.append(kept(df)) or held[-1])
    got = {(r.start, r.goal): r.path and [(h.node, h.direction) for h in r.path] for r in graph.shortest_paths(made(spark, rows), pairs, ["CONTAINS"], 3).collect()}
    assert got["leaf7-3", "hub"] == [("m7", "in"), ("hub", "in")] and got["leaf0-1", "leaf0-2"] == [("m0", "in"), ("leaf0-2", "out")]
    assert got["hub", "hub"] == [] and got["hub", "none"] is None and got["leaf0-1", "leaf1-1"] is None and len(got) == 404
    # from the starts alone, each of 400 would reach the leaves beside it
    fronts = [t.count() for t in held if "node" in t.columns]
    assert max(fronts) < 1000
