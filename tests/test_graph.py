import json

import pytest

from stratagraph import __main__ as cli
from stratagraph.plans import graph
from stratagraph.sources import snapshot


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    ents, facts, ev, cov = [], [], [], []

    def e(key, kind, status=None, **identity):
        ents.append((len(ents), key, f"urn:{key}", kind, identity, {}, status))

    def f(key, predicate, a, b, status=None, **q):
        facts.append((len(facts), key, predicate, a, b, q, status))

    def at(kind, target, path, start, end):
        ev.append((len(ev), f"ev{len(ev)}", kind, target, "deterministic_static", "py", {}, ("r", "c", path, start, end), None, None))

    sym = lambda k, q, kind="function", m="app": e(k, "CodeSymbol", tenant="t", repo="o/r", module=m, qualname=q, symbol_kind=kind)
    for k, q, kind in (("a", "a", "function"), ("b", "b", "function"), ("c", "C", "class"), ("ci", "C.__init__", "method"), ("d", "d", "async_function"), ("z", "z", "function")):
        sym(k, q, kind)
    sym("a2", "a", m="other")
    f("f1", "CALLS", "a", "b"), f("f2", "CALLS", "b", "ci"), f("f3", "CALLS", "d", "c"), f("f4", "CALLS", "z", "a"), f("f5", "CALLS", "b", "a")
    at("entity", "a", "./src/app.py", 1, 9), at("entity", "a2", "src/other.py", 1, 9), at("entity", "b", "src/app.py", 10, 30), at("entity", "c", "src/app.py", 12, 20)
    at("fact", "f1", "src/app.py", 5, 5)
    e("m1", "CodeModule", tenant="t", repo="o/r", module="app.x"), e("m2", "CodeModule", tenant="t", repo="o/r", module="app.y"), e("p1", "ExternalPackage", tenant="t", repo="o/r", name="Requests")
    e("p2", "ExternalPackage", tenant="t", repo="o/r", name="json")
    f("i1", "IMPORTS", "m1", "p1", category="third_party", import_root="requests"), f("i2", "IMPORTS", "m2", "p1", category="third_party"), f("i3", "IMPORTS", "m1", "p2", category="stdlib")
    f("i4", "IMPORTS", "m1", "m2", category="internal_module")
    e("s", "Service", tenant="t", slug="pay"), e("ep1", "Endpoint", repo="o/r", method="GET", host="_", path="/u/{id}"), e("ep2", "Endpoint", repo="o/c", method="GET", host="_", path="/v1/orders")
    e("ep3", "Endpoint", repo="o/r", method="GET", host="_", path="/v1/orderz"), e("ch", "EventChannel", broker_kind="sqs", channel_address="jobs"), e("dom", "Domain", name="api.example.com")
    e("env", "EnvVar", name="API_URL"), e("dt", "DeployTarget", type="wsgi", target="/srv/app.wsgi")
    f("x1", "EXPOSES_ENDPOINT", "s", "ep1"), f("x2", "DOCUMENTS_ENDPOINT", "s", "ep1"), f("x3", "DOCUMENTS_ENDPOINT", "s", "ep2"), f("x4", "EXPOSES_ENDPOINT", "s", "ep3")
    f("v1", "PRODUCES_EVENT", "s", "ch"), f("v2", "REFERENCES_EVENT_CHANNEL", "s", "ch"), f("d1", "REFERENCES_DOMAIN", "env", "dom"), f("d2", "REFERENCES_ENV_VAR", "m1", "env")
    f("t1", "DEPLOYS_VIA_CONFIG", "s", "dt"), f("l1", "RESOLVES_TO_REPO", "p1", "s", consumer_repo="o/r")
    cov.append((0, "c1", "t", "PARSES", {"reason": "x"}, "stale", "py", None)), cov.append((1, "c2", "t", "PARSES", {}, "instrumented", "py", None))
    rows = {"entities": ents, "facts": facts, "support_facts": [], "evidence": ev, "coverage": cov}
    root = f"{tmp_path_factory.mktemp('g')}/s"
    snapshot.write_snapshot({n: spark.createDataFrame(r, snapshot.SCHEMAS[n]) for n, r in rows.items()}, root)
    return root


@pytest.fixture(scope="module")
def g(spark, made):
    return graph.Graph.load(spark, made)


def test_symbols(g):
    assert g.lookup_symbol("app.a")["matches"][0]["entity_id"] == "a"
    assert g.lookup_symbol("a")["status"] == "ambiguous" and g.lookup_symbol("a", path="src/other.py")["matches"][0]["entity_id"] == "a2"
    assert g.lookup_symbol("nothing")["status"] == "not_found" and g.lookup_symbol("__INIT__")["tier"] == "fuzzy"
    assert [r["label"] for r in g.symbols_in_file("src/app.py")["symbols"]] == ["app.a", "app.b", "app.C"]
    assert [r["fact_id"] for r in g.find_callers("app.a")["rows"]] == ["f4", "f5"]
    assert g.find_callers("a")["status"] == "ambiguous" and "rows" not in g.find_callers("a")
    assert g.find_callers("a", include_all=True)["count"] == 2
    assert [r["object_label"] for r in g.find_callees("app.b", limit=1)["rows"]] == ["app.C.__init__"]
    assert [(r["depth"], r["fact_id"]) for r in g.blast_radius("app.z")["edges"]] == [(1, "f4"), (2, "f1")]
    assert [(r["depth"], r["fact_id"]) for r in g.blast_radius("app.a", depth=2)["edges"]] == [(1, "f1"), (2, "f2"), (2, "f5")]
    impact = g.reverse_impact("app.C.__init__")
    assert {(r["label"], r["depth"], r["affected"]) for r in impact["rows"]} >= {("app.b", 1, True), ("app.d", 1, False), ("app.a", 2, True)}
    assert g.evidence_for_call("app.a", "app.b", path="src/app.py", line=5)["evidence"][0]["target_id"] == "f1"
    assert g.dependency_path("app.z", "app.C.__init__")["paths"] == [{"steps": 3, "path": ["app.z", "app.a", "app.b", "app.C.__init__"]}]
    review = g.review([("src/app.py", 13, 14), ("src/app.py", 2, 2)])
    assert [s["label"] for s in review["symbols"]] == ["app.C", "app.a"] and {c["label"] for c in review["callers"]} == {"app.d", "app.z", "app.b"} - {"app.a"}


@pytest.mark.parametrize("parts", [1, 5])
def test_a_limit_cuts_ties_in_the_snapshots_order(spark, parts):
    """Symbols of one file, line and label, and facts of one ordinal, whatever the order of the rows that hold them."""
    same = {"tenant": "t", "repo": "r", "module": "m", "qualname": "f", "symbol_kind": "function"}
    rows = {
        "entities": [(k, f"s{k}", f"u{k}", "CodeSymbol", same, {}, None) for k in range(40)],
        "facts": [(k // 20, f"f{k}", "CALLS", f"s{39 - k}", f"s{k}", {}, None) for k in range(40)],
        "support_facts": [],
        "evidence": [(k, f"e{k}", "entity", f"s{k}", "deterministic_static", "py", {}, ("r", "c", "m.py", 1, 9), None, None) for k in range(40)],
        "coverage": [],
    }
    g = graph.Graph({n: spark.createDataFrame(r[::-1], snapshot.SCHEMAS[n]).repartition(parts) for n, r in rows.items()})
    assert [m["entity_id"] for m in g.lookup_symbol("m.f", limit=7)["matches"]] == [f"s{k}" for k in range(7)]
    assert [r["fact_id"] for r in g.find_callers("m.f", include_all=True, limit=15)["rows"]] == sorted(f"f{k}" for k in range(15))
    assert [r["fact_id"] for r in g.find_callees("m.f", include_all=True, limit=25)["rows"]] == [*sorted(f"f{k}" for k in range(15, 20)), *sorted(f"f{k}" for k in range(20, 40))]


def test_every_match_is_a_target_beyond_the_limit(spark):
    """600 symbols of one name, of which the last, in order of file, is called first."""
    same = {"tenant": "t", "repo": "r", "module": "m", "qualname": "f", "symbol_kind": "function"}
    rows = {
        "entities": [(k, f"s{k}", f"u{k}", "CodeSymbol", same, {}, None) for k in range(600)],
        "facts": [(600 - k, f"f{k}", "CALLS", "s0", f"s{k}", {}, None) for k in range(600)],
        "support_facts": [],
        "evidence": [(k, f"e{k}", "entity", f"s{k}", "deterministic_static", "py", {}, ("r", "c", f"m{k:03}.py", 1, 9), None, None) for k in range(600)],
        "coverage": [],
    }
    g = graph.Graph({n: spark.createDataFrame(r, snapshot.SCHEMAS[n]) for n, r in rows.items()})
    assert [r["fact_id"] for r in g.find_callers("m.f", limit=3, every=True)["rows"]] == ["f599", "f598", "f597"]
    assert {r["fact_id"] for r in g.find_callers("f", limit=500, every=True)["rows"]} == {f"f{k}" for k in range(100, 600)}
    assert [r["fact_id"] for r in g.find_callers("m.f", path="m007.py", every=True)["rows"]] == ["f7"]
    assert g.find_callers("m.f", limit=3)["status"] == "ambiguous" and g.find_callers("none", every=True)["status"] == "not_found"
    assert [r["fact_id"] for r in g.find_callers("m.f", include_all=True, limit=3)["rows"]] == ["f2", "f1", "f0"]


def test_imports(g):
    assert [r["subject_label"] for r in g.modules_importing("requests")["modules"]] == ["app.x", "app.y"]
    assert g.who_imports("requests", 1)["rows"] == [{"prefix": "app", "n": 2}]
    assert g.who_imports("requests", grouping=False, limit=1)["rows"] == [{"subject_label": "app.x", "ordinal": 7 - 2}]
    assert g.dependency_info("requests")["packages"] == [{"name": "Requests", "category": "third_party", "fact_id": "i2"}]
    assert g.top_dependencies()["dependencies"] == [{"object_label": "Requests", "n": 2}, {"object_label": "app.y", "n": 1}]
    assert len(g.top_dependencies(include_stdlib=True)["dependencies"]) == 3
    assert g.top_internal_dependencies()["dependencies"] == [{"object_label": "app.y", "importers": 1}]
    assert g.top_fan_in_symbols(limit=1)["symbols"] == [{"object_label": "app.a", "callers": 2}]
    assert [r["subject_label"] for r in g.modules_importing_both("requests", "json")["modules"]] == ["app.x"]


def test_surfaces(g):
    assert g.cross_repo_links()["link_count"] == 1 and g.repo_dependencies("r")["status"] == "ok" and g.repo_dependencies("no")["status"] == "not_found"
    refs = g.domain_references("example")
    assert [r["fact_id"] for r in refs["references"]] == ["d1", "d2"]
    assert g.endpoints("/u")["endpoint_fact_count"] == 2 and len(g.endpoints(limit=3)["endpoints"]) == 3
    assert [r["linkage"] for r in g.event_channels()["channels"]] == ["known_linked", "candidate"]
    assert g.deploy_mappings("wsgi")["mappings"][0]["linkage"] == "known_linked"
    out = g.reconcile_endpoints()
    assert out["docs_backend"]["matched"] == ["/u/{}"] and out["docs_backend"]["docs_only"] == ["/v1/orders"] and out["docs_clients"]["warnings"] == ["clients has no rows"]
    assert out["docs_backend"]["possible_matches"][0]["right_key"] == "/v1/orderz"
    brief = g.service_brief("pay")
    assert brief["counts"]["EXPOSES_ENDPOINT"] == 2 and len(brief["sections"]["PRODUCES_EVENT"]) == 1 and g.service_brief("none")["status"] == "not_found"
    assert g.summary()["entities"]["CodeSymbol"] == 7 and [x["coverage_id"] for x in g.coverage_gaps()["gaps"]] == ["c1"]


def test_packets(g):
    assert g.planning_context("a")["status"] == "ambiguous" and g.planning_context("none")["status"] == "not_found"
    one = g.planning_context("requests")
    assert one["counts"] == [{"predicate": "IMPORTS", "direction": "in", "n": 2}, {"predicate": "RESOLVES_TO_REPO", "direction": "out", "n": 1}] and len(one["facts"]) == 3
    runtime = g.runtime_map()
    assert runtime == {"status": "ok", "services": [{"service": "pay", "endpoints": 2, "produced": 1, "consumed": 0, "deploys": 1}], "unlinked_routes": []}


def test_budget():
    packet = {"status": "ok", "a": list(range(500)), "b": ["x"]}
    small = graph.within(packet, 300)
    assert len(json.dumps(small["a"], separators=(",", ":"))) < 300 and small["truncated"]["a"] == 500 - len(small["a"]) and small["b"] == ["x"]


def test_command_line(spark, made, capsys):
    cli.main(["--snapshot", made, "find-callers", "app.a", "--limit", "1"])
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["rows"][0]["fact_id"] == "f4"
    args = cli.parser().parse_args(["--snapshot", "x", "reconcile-contract", "n", "endpoint_path", "--left-predicate", "A", "--right-predicate", "B"])
    assert args.left_predicate == ["A"] and args.limit == 100
