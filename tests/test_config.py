"""Workspaces, environment files and the command line."""

import json

import pytest

from tests.services import SHOP, WORKER, write
from weftgraph import __main__ as cli
from weftgraph.operators import evaluate
from weftgraph.plans import golden
from weftgraph.sources import config


def workspace(root, **more):
    write(root / "shop", SHOP), write(root / "worker", WORKER)
    body = {"services": [{"name": "shop", "path": "shop"}, {"name": "worker", "path": "worker", "base_url_envs": ["SHOP_URL"]}], "processes": [{"name": "New Order", "entrypoint": "shop:POST /api/orders/new"}]} | more
    (root / "w.json").write_text(json.dumps(body))
    return str(root / "w.json")


def test_workspace(tmp_path):
    w = config.load_workspace(workspace(tmp_path, idioms={"producers": [{"call": "bus.emit", "kind": "event_type"}]}))
    assert [s.name for s in w.services] == ["shop", "worker"] and w.idioms.producers[0].call == "bus.emit" and len(w.idioms.producers) == 3
    assert config.load_workspace(str(tmp_path / "shop")).services[0].name == "shop"


@pytest.mark.parametrize("bad", [{"services": []}, {"services": [{"name": "a b", "path": "shop"}]}, {"services": [{"name": "a", "path": "none"}]}, {"extra": 1}, {"env_sources": ["none.yaml"]},
                                 {"idioms": {"clients": [{"call": "driver.fetch"}]}}, {"idioms": {"clients": [{"route_from": {"decorator": "path", "no": 1}}]}}, {"idioms": {"clients": ["x"]}},
                                 {"idioms": {"clients": [{"call": "a", "route_from": {"decorator": "path"}, "verb_from": {"request_ctor": "A||B", "enum": "Verb"}}]}},
                                 {"idioms": {"producers": [{"call": "a", "topic": {"const": "x", "arg": 1}}]}}, {"idioms": {"producers": [{"call": "a", "topic": {}}]}},
                                 {"idioms": {"consumers": [{"form": "base_class", "name": "A", "topic": {"arg": 1}}]}},
                                 {"idioms": {"producers": [{"call": "a||b"}]}}, {"idioms": {"consumers": [{"form": "x", "name": "y"}]}}, {"services": [{"name": "a", "path": "shop", "no": 1}]}])
def test_bad_workspaces(tmp_path, bad):
    with pytest.raises(config.ConfigError):
        config.load_workspace(workspace(tmp_path, **bad))


def test_decorated_clients(tmp_path):
    rule = {"file_glob": "*.py", "class_glob": "*Api", "call": "driver.fetch", "route_from": {"decorator": "path"}, "verb_from": {"request_ctor": "Request", "enum": "Verb"}}
    first = config.load_workspace(workspace(tmp_path, idioms={"clients": [rule]})).idioms.clients[0]
    assert (first.route_from.decorator, first.route_from.arg, first.verb_from.enum) == ("path", 0, "Verb")


def test_env_files(tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"env": [{"name": "SHOP_URL", "value": "http://Shop.svc:80/x"}, {"name": "MAIL", "value": "https://mail.example.com"}], "deep": {"PLAIN": "text"}}))
    (tmp_path / "b.json").write_text(json.dumps({"PLAIN": "later"}))
    (tmp_path / "c.json").write_text("{")
    warned = []
    pairs = config.env_pairs(tuple(str(tmp_path / f"{x}.json") for x in "abc"), warned.append)
    assert pairs == {"SHOP_URL": "http://Shop.svc:80/x", "MAIL": "https://mail.example.com", "PLAIN": "later"} and len(warned) == 1
    services = (config.Service("shop", "x"), config.Service("w", "x", (), ("MAIL",)))
    assert config.env_maps(pairs, services) == ({"MAIL": "w"}, {"SHOP_URL": "shop"}, {"SHOP_URL": "shop.svc", "MAIL": "mail.example.com"})


def test_init(tmp_path):
    assert cli.main(["init", str(tmp_path)]) == 0 and cli.main(["init", str(tmp_path)]) == 1
    assert [s.path for s in config.load_workspace(str(tmp_path / "weftgraph.json")).services] == [str(tmp_path)]


def test_golden_edges(spark, tmp_path):
    dst = {"service": "s", "symbol": "m.g"}
    rows = [{"type": t, "src": {"service": "s", "symbol": "m.f"}, "dst": d} for t, d in (("CALLS", dst), ("CALLS", dst), ("PRODUCES", {"channel": "chan:x:y"}), ("HANDLES", {"channel": "chan:z"}))]
    (tmp_path / "e.json").write_text(json.dumps({"edges": [*rows, {**rows[0], "src": {"service": "s", "symbol": "other"}, "mechanism": "start"}]}))
    assert {tuple(r) for r in golden.golden_edges(spark, str(tmp_path / "e.json"), ["CALLS", "PRODUCES"]).collect()} == {("s", "m.f", "s", "m.g", "CALLS"), ("s", "m.f", None, "chan:x:y", "PRODUCES")}
    (tmp_path / "none.yaml").write_text("")
    assert golden.golden_edges(spark, str(tmp_path / "none.yaml"), ["CALLS"]).count() == 0 and golden.golden_questions(str(tmp_path / "none.yaml")) == []
    edges = spark.createDataFrame([("sym:s:f", "sym:s:g", "CALLS"), ("sym:s:f", "chan:x:y", "PRODUCES"), ("chan:x:y", "sym:s:g", "HANDLES"), ("sym:s:lost", "chan:x:y", "PRODUCES"), ("chan:x:y", "sym:s:lost", "HANDLES")], "src string, dst string, type string")
    nodes = spark.createDataFrame([("sym:s:f", "s", "m.f"), ("sym:s:g", "s", "m.g"), ("sym:s:lost", "s", "")], "id string, service string, qualified_name string")
    found, dangling = evaluate.found_edges(edges, nodes, ["CALLS", "PRODUCES", "HANDLES"])
    assert {tuple(r) for r in found.collect()} == {("s", "m.f", "s", "m.g", "CALLS"), ("s", "m.f", None, "chan:x:y", "PRODUCES"), ("s", "m.g", None, "chan:x:y", "HANDLES")}
    assert dangling.first().dangling == 2


def test_command_line(spark, tmp_path, capsys):
    w, out = workspace(tmp_path, processes=[{"name": "New Order", "entrypoint": "shop:POST /api/orders/new"}, {"name": "Lost", "entrypoint": "shop:GET /none"}]), str(tmp_path / "out")
    assert cli.main(["doctor", w]) == 0 and cli.main(["doctor", str(tmp_path / "none.json")]) == 1 and cli.main([]) == 2
    assert cli.main(["index", w, out]) == 0 and '"processes_unresolved": 1' in capsys.readouterr().out
    assert cli.main(["stats", out]) == 0
    capsys.readouterr()
    assert cli.main(["trace", out, "shop:POST /api/orders/new"]) == 0
    assert "on_order" in capsys.readouterr().out
    asked = [{"question": "create order", "accept": [{"service": "shop", "symbol": "app.routes.create_order"}], "k": 5}, {"question": "create order", "accept": [{"service": "worker", "symbol": "app.routes.create_order"}], "k": 3}, {"question": "create order", "accept": []}]
    (tmp_path / "q.json").write_text(json.dumps({"questions": asked}))
    found = golden.retrieval(cli.open_api(spark, out), golden.golden_questions(str(tmp_path / "q.json")))
    assert [(r["hit"], r["rank"]) for r in found] == [(True, 0), (False, None), (False, None)]
    assert cli.main(["eval", out, str(tmp_path / "q.json")]) == 0 and "1 of 3" in capsys.readouterr().out
    assert cli.main(["trace", out, "nothing"]) == 1 and cli.main(["search", out, "create_order"]) == 0
    assert [p["id"] for p in cli.open_api(spark, out).list_processes()["processes"]] == ["proc:new-order", "proc:worker-orderflow"]
