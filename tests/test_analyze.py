"""The front end on small services: facts, extraction, linking, and the golden edges they must give."""

import pytest
from pyspark.sql import functions as F

from tests.services import DOCS, SHOP, WORKER, write
from weftgraph.operators import extract
from weftgraph.plans import analyze
from weftgraph.sources.files import gitignore_lines, glob_to_regex, scan_service
from weftgraph.sources.pyfacts import facts, file_facts, parse


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("services")
    return analyze.index(spark, {"shop": write(root / "shop", SHOP), "worker": write(root / "worker", WORKER), "docs": write(root / "docs", DOCS)})


def edges(graph, *types):
    return {(r.src, r.type, r.dst) for r in graph.edges.where(F.col("type").isin(*types)).collect()}


def test_scan_leaves_out_what_is_ignored(spark, tmp_path):
    rows = {r.relpath: r.size for r in scan_service(spark, write(tmp_path, SHOP), "shop").collect()}
    assert set(rows) == {"app/__init__.py", "app/main.py", "app/routes.py", "app/service.py", "app/bus.py", "broken.py"}
    assert rows["app/__init__.py"] == 0
    assert gitignore_lines("# x\n\nbuild/\n*.py\n") == ["build/", "*.py"]


@pytest.mark.parametrize(("glob", "path", "hit"), [("build/", "a/build/x.py", True), ("/build", "a/build", False), ("*.py", "a/b.py", True), ("a/*.py", "a/b/c.py", False), ("a/**", "a/b/c.py", True), ("**/x/**", "x/y.py", True)])
def test_globs(glob, path, hit):
    import re

    assert bool(re.match(glob_to_regex(glob), path)) == hit


def test_golden_edges(graph):
    shop, worker, docs = "sym:shop:`app.", "sym:worker:`worker.", "sym:docs:`"
    assert edges(graph, "HANDLES") == {
        ("chan:http:shop:POST /api/orders/new", "HANDLES", shop + "routes`/create_order()."),
        ("chan:http:shop:GET /api/orders", "HANDLES", shop + "routes`/list_orders()."),
        ("chan:http:docs:GET /docs/{doc_uid}", "HANDLES", docs + "api`/get_document()."),
        ("chan:http:docs:GET /health", "HANDLES", docs + "deps`/health()."),
    }
    assert edges(graph, "DEPENDS_ON") == {(docs + "deps`/health().", "DEPENDS_ON", docs + "deps`/get_db().")}
    assert edges(graph, "PRODUCES") == {
        (shop + "service`/place().", "PRODUCES", "chan:event_type:OrderPlaced"),
        (docs + "api`/get_document().", "PRODUCES", "chan:temporal_signal:approved"),
        *((docs + "deps`/health().", "PRODUCES", f"chan:event_type:{v}") for v in "ab"),
    }
    assert edges(graph, "CONSUMES") == {
        (worker + "handlers`/on_order().", "CONSUMES", "chan:event_type:OrderPlaced"),
        (worker + "flow`/OrderFlow#approve().", "CONSUMES", "chan:temporal_signal:approved"),
    }
    assert edges(graph, "CALLS_HTTP") == {(worker + "docs_client`/DocsClient#get_doc().", "CALLS_HTTP", "chan:http:docs:GET /docs/{doc_uid}")}
    assert edges(graph, "INVOKES_ACTIVITY") == {(worker + "flow`/OrderFlow#run().", "INVOKES_ACTIVITY", worker + "flow`/load().")}
    assert edges(graph, "NEXT_SEGMENT") == {
        (shop + "service`/place().", "NEXT_SEGMENT", worker + "handlers`/on_order()."),
        (worker + "docs_client`/DocsClient#get_doc().", "NEXT_SEGMENT", docs + "api`/get_document()."),
        (docs + "api`/get_document().", "NEXT_SEGMENT", worker + "flow`/OrderFlow#approve()."),
    }
    calls = edges(graph, "CALLS")
    assert {
        (shop + "routes`/create_order().", "CALLS", shop + "service`/place()."),
        (worker + "handlers`/on_order().", "CALLS", worker + "flow`/OrderFlow#run()."),
        (worker + "flow`/load().", "CALLS", worker + "docs_client`/fetch()."),
        (worker + "docs_client`/fetch().", "CALLS", worker + "docs_client`/DocsClient#get_doc()."),
        (shop + "service`/place().", "CALLS", shop + "service`/check()."),
    } <= calls


def test_nodes_roles_and_repeated_definitions(graph):
    rows = {r.id: r for r in graph.nodes.collect()}
    assert "sym:shop:`app.service`/check()." in rows and "sym:shop:`app.service`/check().~2" in rows
    assert rows["sym:shop:`app.routes`/create_order()."].roles == ["RouteHandler"]
    assert rows["sym:worker:`worker.flow`/OrderFlow#"].roles == ["TemporalWorkflow"]
    assert rows["sym:worker:`worker.flow`/OrderFlow#"].props == {"workflow_name": "OrderFlow"}
    assert rows["sym:shop:`app.routes`/create_order()."].props == {"http_method": "POST", "path_template": "/new"}
    assert not rows["sym:shop:`app.service`/place()."].props
    assert ("sym:shop:`app.main`/", "IMPORTS", "sym:shop:`app.routes`/") in edges(graph, "IMPORTS")
    assert len(rows) == graph.nodes.count()
    known = set(rows)
    assert all(r.src in known and r.dst in known for r in graph.edges.collect())


def test_processes(graph):
    got = {(r.process, r.source) for r in graph.processes.collect()}
    assert got == {("proc:worker-orderflow", "temporal")}
    assert {(r.node, r.order) for r in graph.members.collect()} == {("sym:worker:`worker.flow`/OrderFlow#", 0)}


def test_removing_an_idiom_removes_its_edges(spark, tmp_path):
    found = analyze.index(spark, {"shop": write(tmp_path, SHOP)}, extract.Idioms(producers=(extract.Producer("other.call"),)))
    assert found.edges.where("type = 'PRODUCES'").count() == 0


def test_settings_and_enums(spark, tmp_path):
    files = scan_service(spark, write(tmp_path, DOCS), "docs")
    parsed = parse(files)
    modules = extract.module_table(files)
    got = {(r.class_fqn, r.name): (r.default, r.env_name, r.is_enum) for r in extract.class_attributes(parsed, extract.definitions(parsed, modules)).collect()}
    assert got == {
        ("settings.Settings", "topic"): ("docs", "DOCS_TOPIC", False), ("settings.Settings", "url"): ("u", "DOC_URL", False),
        ("settings.Kind", "A"): ("a", None, True), ("settings.Kind", "B"): ("b", None, True),
    }
    assert facts(parsed, "def").where("name = 'get_document'").first()["signature"] == "def get_document(doc_uid)"


def test_facts_of_odd_files():
    assert file_facts(b"") == [] and file_facts(b"def (:")[0][0] == "error"
    rows = dict(file_facts("x = 'é'; f(g(1))\n".encode())[1:])
    assert rows["call"]["callee"] == "g" and rows["call"]["pos"] == 12


CLIENTS = {
    "pay/settings.py": '''from pydantic_settings import BaseSettings


class Settings(BaseSettings):
    ledger_url: str = "http://ledger"
    bank_url: str = "https://bank"


settings = Settings()
''',
    "pay/ledger_client.py": '''import os
from pay.settings import settings


class LedgerClient:
    def __init__(self, session):
        self.host = settings.ledger_url
        self.session = session

    def entry(self, entry_id):
        return self.session.get(f"{self.host}/entries/{entry_id}")


class BankClient:
    def __init__(self, session):
        self.host = os.environ["BANK_URL"]

    def rate(self):
        return self.session.get(f"{self.host}/rates/today")


class OddClient:
    def __init__(self, session):
        self.host = os.getenv("ODD_URL")

    def odd(self):
        return self.session.post(f"{self.host}/entries/{1}")
''',
}
LEDGER = {"ledger/api.py": '''from fastapi import FastAPI

app = FastAPI()


@app.get("/entries/{entry_id}")
def read_entry(entry_id):
    return entry_id
'''}


def test_calls_are_anchored_external_or_unmapped(spark, tmp_path):
    services = {"pay": write(tmp_path / "pay", CLIENTS), "ledger": write(tmp_path / "ledger", LEDGER)}
    envs = ({"LEDGER_URL": "ledger"}, {}, {"BANK_URL": "api.bank.example"})
    graph = analyze.index(spark, services, None, envs)
    got = {r.src.rsplit("/", 1)[1]: (r.dst, r.resolution, r.confidence, r.external, r.external_host) for r in graph.edges.where("type = 'CALLS_HTTP'").collect()}
    assert got == {
        "LedgerClient#entry().": ("chan:http:ledger:GET /entries/{entry_id}", "static", 1.0, False, None),
        "BankClient#rate().": ("chan:http:?:GET /rates/today", "heuristic", 0.5, True, "api.bank.example"),
        "OddClient#odd().": ("chan:http:?:POST /entries/{value}", "heuristic", 0.5, False, None),
    }
    trace = __import__("weftgraph.operators.trace", fromlist=["x"])
    bank = trace.trace_process(graph.edges, graph.nodes, "sym:pay:`pay.ledger_client`/BankClient#rate().")
    assert (bank["external_exit_count"], bank["confidence"]) == (1, 1.0) and bank["segments"][0]["exits"][0]["external_host"] == "api.bank.example"
    odd = trace.trace_process(graph.edges, graph.nodes, "sym:pay:`pay.ledger_client`/OddClient#odd().")
    assert (odd["external_exit_count"], odd["confidence"]) == (0, 0.5)


DECORATED = {"till/ledger_api.py": '''import os
from lib import Driver, Request, Verb, route

BOOK = "/entries/book"


class Outer:
    class LedgerApi:
        def __init__(self):
            self.driver = Driver()
            self.host = os.environ["LEDGER_URL"]

        @route("/entries/{entry_id}")
        def entry(self, entry_id):
            def send():
                return self.driver.fetch_body(Request(Verb.GET, entry_id))
            return send()

        @log
        @route(BOOK)
        async def book(self):
            request = ProxyRequest(Verb.put)
            self.driver.fetch(Request(Other.POST))
            return await self.driver.fetch(request)

        @route("entries")
        def no_path(self):
            return self.driver.fetch(Request(Verb.GET))

        @route("/none")
        def no_verb(self):
            return self.driver.fetch(Request("GET"))

        @route("/other")
        def not_sent(self):
            return self.other.fetch(Request(Verb.GET))

        def bare(self):
            return self.driver.fetch(Request(Verb.GET))

        @route("/twice")
        def twice(self):
            self.driver.get("/first")
            return Request(Verb.POST)

    @route("/outside")
    def outside(self):
        return self.driver.fetch(Request(Verb.GET))
'''}


def test_paths_of_decorators_and_verbs_of_requests(spark, tmp_path):
    sdk = extract.HttpClient("*.py", "*Api", "driver.fetch_body|driver.fetch|driver.get", extract.RouteFrom("route"), extract.VerbFrom("Request|ProxyRequest", "Verb"))
    plain = extract.HttpClient("*_api.py", "*Api")
    services = {"till": write(tmp_path / "till", DECORATED), "ledger": write(tmp_path / "ledger", LEDGER)}

    def found(*clients):
        calls = analyze.extract_all(analyze.scan(spark, services), extract.Idioms(clients=clients))["http"].collect()
        return {(r.src.rsplit("#", 1)[1], r.method, r.path, r.hint, r.line, r.env) for r in calls}

    sent = {("entry().", "GET", "/entries/{entry_id}", "static", 16, "LEDGER_URL"), ("book().", "PUT", BOOK, "static", 23, "LEDGER_URL")}
    verb, twice = ("twice().", "GET", "/first", "static", 43, "LEDGER_URL"), ("twice().", "POST", "/twice", "static", 43, "LEDGER_URL")
    assert found(sdk, plain) == {*sent, twice}
    assert found(plain, sdk) == {*sent, verb}
    graph = analyze.index(spark, services, extract.Idioms(clients=(sdk,)), ({"LEDGER_URL": "ledger"}, {}, {}))
    assert ("sym:till:`till.ledger_api`/Outer#LedgerApi#entry().", "CALLS_HTTP", "chan:http:ledger:GET /entries/{entry_id}") in edges(graph, "CALLS_HTTP")


BOOK = "/entries/book"


CARRIED = {
    "mill/send.py": '''from mill.bus import post

LANE = "mill.lane"


def ground(sack, lane):
    post("Ground", LANE)
    post("Sieved", topic=lane)
    post("Bagged", settings.bag_lane)
''',
    "mill/settings.py": '''class MillSettings(BaseSettings):
    store_lane: str = "store.lane"
    bare_lane: str
''',
}
STORE = {"store/take.py": '''from store.bus import Table


class Ground(Taker[GroundSack]):
    def take(self, sack):
        return sack


def bagged(sack):
    return sack


Table(["store.bags"], {"Bagged": bagged, "Lost": lost})
''', "store/settings.py": '''class StoreSettings(BaseSettings):
    lane: str = "store.lane"
    bare: str
'''}


@pytest.mark.parametrize(("topic", "lane"), [({"settings": "StoreSettings.lane"}, ("store.lane", "static", 1.0)), ({"settings": "StoreSettings.bare"}, ("${BARE}", "heuristic", 0.6)), ({"attr": "self.lane"}, ("${self.lane}", "heuristic", 0.6)), ({"settings": "None.lane"}, None)])
def test_topics_contain_their_events(spark, tmp_path, topic, lane):
    post = extract.Producer("post", "event_type", 0, None, extract.Topic(arg=1))
    rules = (extract.Consumer("base_class", "Taker", handler="take", topic=extract.Topic(**topic)), extract.Consumer("dispatch_dict", "Table", position=1, topic=extract.Topic(const="store.bags")))
    services = {"mill": write(tmp_path / "mill", CARRIED), "store": write(tmp_path / "store", STORE)}
    found = analyze.extract_all(analyze.scan(spark, services), extract.Idioms((post,), rules))["edges"].where("type = 'CONTAINS' AND src LIKE 'chan:%'").collect()
    got = {(r.src.removeprefix("chan:kafka_topic:"), r.dst.removeprefix("chan:event_type:"), r.resolution, r.confidence) for r in found}
    assert got == {("mill.lane", "Ground", "static", 1.0), ("${bag_lane}", "Bagged", "heuristic", 0.6), ("store.bags", "Bagged", "static", 1.0)} | ({(lane[0], "GroundSack", *lane[1:])} if lane else set())


def test_a_topics_consumer_takes_its_events(spark, tmp_path):
    post = extract.Producer("post", "event_type", 0, None, extract.Topic(const="mill.lane"))
    taker = {"sink/main.py": "def drain():\n    KafkaConsumer('mill.lane')\n"}
    services = {"mill": write(tmp_path / "mill", CARRIED), "sink": write(tmp_path / "sink", taker)}
    graph = analyze.index(spark, services, extract.Idioms((post,)))
    hand = {(r.src, r.dst, r.via_channel) for r in graph.edges.where("type = 'NEXT_SEGMENT'").collect()}
    assert hand == {("sym:mill:`mill.send`/ground().", "sym:sink:`sink.main`/drain().", f"chan:event_type:{e}") for e in ("Ground", "Sieved", "Bagged")}


TIERS = {"kiln/fire.py": '''import stoker.lib
from stoker.bus import Horn
from kiln.bell import ring

fan = Horn()


def path(x):
    x.Horn.sound("a")


def bound():
    fan.sound("b")


def imported(x):
    x.sound("c")


def chained(x):
    x.fan.sound("d")


def qualified():
    ring("e")


def setting():
    fan.sound(settings.name)


def other(x):
    x.silent("f")
''', "kiln/bell.py": "def ring(name):\n    return name\n", "kiln/away.py": "def away(x):\n    x.sound('g')\n"}


def test_tiers_of_idioms(spark, tmp_path):
    rules = (extract.Producer("stoker.bus.Horn.sound|Horn.sound"), extract.Producer("kiln.bell.ring"))
    found = analyze.extract_all(analyze.scan(spark, {"kiln": write(tmp_path, TIERS)}), extract.Idioms(rules))["edges"].where("type = 'PRODUCES'").collect()
    got = {(r.src.rsplit("/", 1)[1], r.dst.rsplit(":", 1)[1], r.resolution, r.confidence) for r in found}
    assert got == {
        ("path().", "a", "static", 1.0), ("bound().", "b", "heuristic", 0.8), ("imported().", "c", "heuristic", 0.6), ("chained().", "d", "heuristic", 0.6),
        ("qualified().", "e", "static", 1.0), ("setting().", "${name}", "heuristic", 0.6),
    }


def expected_chunks(source: bytes, most: int):
    """Chunks of a file by its syntax tree, written plainly: (symbol, ord, text, first line)."""
    import ast

    starts = [0]
    for line in source.splitlines(keepends=True):
        starts.append(starts[-1] + len(line))
    span = lambda n: (starts[n.lineno - 1] + n.col_offset, starts[n.end_lineno - 1] + n.end_col_offset)
    named = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
    top = [n for n in ast.parse(source).body if isinstance(n, named)]
    found, counts = [], {}

    def add(symbol, a, b, whole=False):
        text, pieces, at = source[a:b], [], a
        for line in text.splitlines(keepends=True) if len(text) > most and not whole else [text]:
            if pieces and len(pieces[-1][1]) + len(line) <= most and not whole:
                pieces[-1] = (pieces[-1][0], pieces[-1][1] + line)
            else:
                pieces.append((at, line))
            at += len(line)
        for at, piece in pieces:
            found.append((symbol, counts.setdefault(symbol, 0), piece.decode(), source[:at].count(b"\n") + 1))
            counts[symbol] += 1

    head = span(top[0])[0] if top else len(source)
    if source[:head].strip():
        add("", 0, head, True)
    for n in top:
        a, b = span(n)
        inner = [m for m in n.body if isinstance(m, named)] if isinstance(n, ast.ClassDef) and b - a > most else []
        at = a
        for m in inner:
            c, d = span(m)
            gap = c
            while source[gap - 1 : gap] in (b" ", b"\t"):
                gap -= 1
            if source[at:gap].strip():
                add(n.name, at, gap)
            add(f"{n.name}.{m.name}", c, d)
            at = d + (source[d : d + 1] == b"\n")
        if not inner:
            add(n.name, a, b)
        elif source[at:b].strip():
            add(n.name, at, b)
    return sorted(found)


SOURCES = {
    "a.py": '"""Head."""\nimport os\n\n\ndef small():\n    return "\u00e9"\n\n\nclass Big:\n    """Doc."""\n\n    x = 1\n\n    @deco\n    def one(self):\n        def inner():\n            return 1\n        return inner\n    y = 2\n\n    def two(self):\n' + "        long = 1\n" * 30 + "\n    z = 3\n",
    "b.py": "class Flat:\n" + "".join(f"    v{k} = {k}\n" for k in range(40)),
    "c.py": "x = 1\n" * 60,
    "d.py": "def f():\n    s = '" + "q" * 300 + "'\n    return s\n",
    "e.py": "\n\n",
}


@pytest.mark.parametrize("most", [2000, 150])
def test_chunks_follow_definitions(spark, tmp_path, most):
    from weftgraph.operators import chunks

    files = scan_service(spark, write(tmp_path, SOURCES), "s")
    parsed = parse(files)
    modules = extract.module_table(files)
    defs = extract.definitions(parsed, modules)
    names = {r.id: r.qualname for r in defs.collect()}
    got: dict = {}
    for r in chunks.chunk_files(files, defs, modules, most).collect():
        got.setdefault(r.relpath, []).append((names.get(r.symbol_id, ""), r.ord, r.text, r.start_line))
        assert r.end_line == r.start_line + len(r.text.rstrip("\n").split("\n")) - 1 + max(0, len(r.text) - len(r.text.rstrip("\n")) - 1)
    for name, source in SOURCES.items():
        assert sorted(got.get(name, [])) == expected_chunks(source.encode(), most), name


def test_chunk_headers(graph):
    rows = {r.symbol_id: r for r in graph.chunks.collect()}
    got = rows["sym:shop:`app.routes`/create_order()."]
    assert got.context_header.split("\n") == ["file: app/routes.py \u00b7 service: shop", "symbol: app.routes.create_order (Function, RouteHandler)", "imports: app.service.place, fastapi.APIRouter", "doc: Takes an order.", "calls: place"]
    assert got.chunk_kind == "Function" and got.text.startswith("async def create_order") and got.input_hash
