"""The tools, incremental runs and the file stream over small services."""

import pytest
from pyspark.sql import functions as F

from tests.services import DOCS, SHOP, WORKER, write
from weftgraph.api import Api
from weftgraph.operators import chunks, processes
from weftgraph.plans import incremental, snapshot
from weftgraph.streaming.watch import apply_batch, watch

CREATE = "sym:shop:`app.routes`/create_order()."
ON_ORDER = "sym:worker:`worker.handlers`/on_order()."


@pytest.fixture(scope="module")
def roots(tmp_path_factory):
    root = tmp_path_factory.mktemp("api")
    write(root / "shop", SHOP), write(root / "worker", WORKER), write(root / "docs", DOCS)
    return root


@pytest.fixture(scope="module")
def state(spark, roots):
    return incremental.refresh(spark, {s: str(roots / s) for s in ("shop", "worker", "docs")}, None)


@pytest.fixture(scope="module")
def graph(state):
    return incremental.rebuild(state[0])


@pytest.fixture(scope="module")
def api(spark, graph):
    text = graph.files.select("relpath", F.decode("content", "UTF-8").alias("text"))
    made = chunks.chunk_rows(text, "relpath", "text").select(F.col("chunk_id").alias("id"), F.col("symbol_id").alias("symbol"), F.lit("shop").alias("service"), "text", F.lit(None).cast("array<float>").alias("vector"), "start_line")
    return Api(graph.nodes, graph.edges, graph.files, graph.processes, made)


def test_stats_and_source(api):
    stats = api.graph_stats()
    assert stats["nodes"]["Service"] == 3 and stats["edges"]["NEXT_SEGMENT"] == 3
    got = api.get_source(CREATE)
    assert got["source"].startswith("async def create_order") and got["file"] == "app/routes.py" and got["stale"] is False
    assert api.get_source(CREATE, 1)["source"].startswith("@router.post") and "error" in api.get_source("nobody")


def test_neighbors_callers_and_paths(api):
    got = api.expand_neighbors(CREATE, ["CALLS"], "out")
    assert [h["neighbor"] for h in got["hops"]] == ["sym:shop:`app.service`/place()."] and not got["truncated"]
    assert "error" in api.expand_neighbors(CREATE, direction="sideways") and api.expand_neighbors("nobody") == {"nodes": [], "hops": [], "truncated": False}
    assert [c["id"] for c in api.who_calls("sym:shop:`app.service`/check().", True)["callers"]] == ["sym:shop:`app.service`/place().", CREATE]
    assert api.who_calls("nobody")["callers"] == []
    path = api.find_paths(CREATE, "chan:event_type:OrderPlaced")["path"]
    assert [p["node"] for p in path] == [CREATE, "sym:shop:`app.service`/place().", "chan:event_type:OrderPlaced"]
    assert api.find_paths(CREATE, "nobody")["path"] is None and len(api.find_paths(CREATE, CREATE)["path"]) == 1


def test_trace_across_three_services(api):
    got = api.trace_process("shop:POST /api/orders/new")
    assert [s["entry"] for s in got["segments"]] == [CREATE, ON_ORDER, "sym:docs:`api`/get_document().", "sym:worker:`worker.flow`/OrderFlow#approve()."]
    assert got["segments"][0]["exits"][0]["next_entry_ids"] == [ON_ORDER] and got["confidence"] == 0.6 and not got["truncated"]
    assert api.trace_process("shop:app.routes.create_order")["segments"][0]["entry"] == CREATE
    assert "error" in api.trace_process(CREATE, direction="upstream") and "error" in api.trace_process("no such")


def test_search_and_processes(api):
    got = api.search_code("create_order router", mode="text")
    assert got["mode_used"] == "text" and got["results"][0]["symbol"] == "app/routes.py"
    assert "error" in api.search_code("x", mode="vector") and "error" in api.search_code("x", mode="other")
    assert api.find_entrypoint("create order")["results"][0]["id"] == CREATE
    assert [p["id"] for p in api.list_processes()["processes"]] == ["proc:worker-orderflow"]


def test_hybrid_search_with_the_stand_in_embedder(spark, api):
    import pyarrow as pa

    def embed(text):
        batch = pa.RecordBatch.from_arrays([pa.array([""]), pa.array([text])], names=["a", "b"])
        return next(iter(chunks.hash_embedder(8)([batch]))).column(1)[0].as_py()

    asked = api.chunks.drop("vector").withColumnRenamed("id", "chunk_id").withColumns({"input_hash": F.sha2("text", 256), "context_header": F.lit("h"), "embedding": F.lit(None).cast("array<float>"), "embed_model": F.lit(None).cast("string"), "embedded_hash": F.lit(None).cast("string")})
    cache = spark.createDataFrame([], "input_hash string, embed_model string, dim int, vec array<float>")
    done, new = chunks.embed_missing(asked, cache, chunks.hash_embedder(8), "m", 8)
    assert new.count() == asked.select("input_hash").distinct().count() and chunks.missing_vectors(done, "m").isEmpty()
    again, none = chunks.embed_missing(done, new, chunks.hash_embedder(8), "m", 8)
    assert none.isEmpty() and again.count() == done.count()
    hybrid = Api(api.nodes, api.edges, api.files, api.processes, done.select(F.col("chunk_id").alias("id"), "symbol", "service", "text", F.col("embedding").alias("vector"), "start_line"), embed)
    assert hybrid.search_code("create_order router")["mode_used"] == "hybrid" and hybrid.search_code("x", mode="vector")["results"]


def test_declared_processes(spark, graph):
    declared = spark.createDataFrame([("New order", "shop:POST /api/orders/new"), ("By name", "worker:worker.handlers.on_order"), ("Lost", "shop:GET /none"), ("Bad", "nocolon")], "name string, selector string")
    assert {r.name: r.entry for r in processes.resolve(declared, graph.nodes, graph.edges).collect()} == {"New order": CREATE, "By name": ON_ORDER, "Lost": None, "Bad": None}


def test_incremental_equals_full(spark, roots, state, graph):
    services = {s: str(roots / s) for s in ("shop", "worker", "docs")}
    first, mode = state
    assert mode == "full" and incremental.refresh(spark, services, first)[1] == "skipped"
    (roots / "shop/app/service.py").write_text(SHOP["app/service.py"].replace('"OrderPlaced"', '"OrderMoved"'))
    (roots / "shop/app/bus.py").unlink()
    (roots / "shop/app/extra.py").write_text("def more():\n    return 1\n")
    later, mode = incremental.refresh(spark, services, first)
    assert mode == "incremental"
    full, _ = incremental.refresh(spark, services, None)
    a, b = incremental.dump(incremental.rebuild(later)), incremental.dump(incremental.rebuild(full))
    assert a == b and a != incremental.dump(graph)


def test_file_stream_and_snapshots(spark, tmp_path):
    root, source = f"{tmp_path}/table", f"{tmp_path}/in"
    schema = "service string, relpath string, content binary, version int"
    batch = lambda rows: spark.createDataFrame(rows, schema)
    batch([("s", "a.py", b"x = 1", 1), ("s", "a.py", b"x = 2", 2), ("s", "b.py", b"y", 1)]).write.parquet(source)
    seen = []
    watch(spark.readStream.schema(schema).parquet(source), root, f"{tmp_path}/cp", lambda df: seen.append(sorted(r.relpath for r in df.collect()))).awaitTermination()
    assert seen == [["a.py", "b.py"]]
    at = snapshot.counter(spark, root)
    one, two = batch([("s", "x.py", b"1", 1)]), batch([("s", "y.py", b"2", 1)])
    other = f"{tmp_path}/other"
    snapshot.publish(one, other, 0)
    with pytest.raises(RuntimeError, match="another writer"):
        snapshot.publish(two, other, 0)
    assert at == 1 and [r.relpath for r in snapshot.read_current(spark, other).collect()] == ["x.py"]
    stale = apply_batch(spark, root, batch([("s", "a.py", b"x = 2", 3), ("s", "b.py", None, 3), ("s", "c.py", b"z", 3)]))
    assert [r.relpath for r in stale.collect()] == ["c.py"]
    assert sorted(r.relpath for r in snapshot.read_current(spark, root).collect()) == ["a.py", "c.py"]
    assert snapshot.current_version(spark, f"{tmp_path}/none") is None
