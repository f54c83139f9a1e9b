import pytest

from stratagraph.plans import packets

from .test_graph import g, made  # noqa: F401


def test_contract_tells_facts_leads_and_gaps():
    found = packets.contract({"status": "ok", "rows": [{"a": 1}]}, "t")
    assert found["answerability"]["status"] == "answerable" and found["proven_facts"]["sources"] == [{"field": "rows", "count": 1}]
    weak = packets.contract({"status": "ok", "rows": [{"a": 1}], "cross_repo_leads": [{}]}, "t")
    assert weak["answerability"]["status"] == "partial" and weak["candidate_leads"]["status"] == "found" and weak["inspection_areas"]
    vague = packets.contract({"status": "ambiguous", "candidates": [{"x": 1}]}, "t")
    assert vague["answerability"] == {"status": "not_answerable", "missing_fact_families": ["ambiguous_anchor"], "recommended_source_checks": []}
    assert {x["trigger"] for x in vague["coverage_gaps"]} == {"missing_fact_family", "ambiguous"} and len(vague["next_actions"]) == 2


def test_budget_steps():
    packet = {"status": "ok", "a": [{"t": "x" * 100, "i": i} for i in range(400)], "b": [{"i": 1}], "answerability": {"rows": [{"i": i} for i in range(30)]}}
    assert packets.budgeted(packet, most=10**6) == packet
    small = packets.budgeted(packet, most=8_000)
    assert len(small["a"]) == 8 and len(packets.canonical(small)) <= 8_000 and small["output_budget"]["truncated_sections"] == ["a"]
    assert len(small["answerability"]["rows"]) == 30
    tight = packets.budgeted({"status": "ok", "a": [{"t": "x" * 3000, "i": i} for i in range(4)], "b": [{"i": 1}]}, most=6_500)
    assert tight["output_budget"]["truncated"] and len(packets.canonical(tight)) <= 6_500
    text = packets.budgeted({"status": "ok", "t": "x" * 9_000}, most=5_000)
    assert text["output_budget"]["exceeded_after_minimization"]


def test_plans(g):  # noqa: F811
    steps = packets.retrieval_steps([{"kind": "Symbol", "value": " app.a "}, {"kind": "Symbol", "value": "app.a"}, {"kind": "Domain", "value": "api.example.com"}])
    assert [s["command"] for s in steps] == ["lookup_symbol", "domain_references"] and steps[1]["step"] == "domain_api_example_com"
    for bad in ({"anchors": [{"kind": "X", "value": "y"}]}, {"anchors": [{"kind": "Symbol", "value": " "}]}, {"anchors": []}, {"anchors": [{"kind": "Repo", "value": str(i)} for i in range(9)]}):
        with pytest.raises(ValueError):
            packets.checked_plan(bad)
    out = packets.answered(g, "who?", {"anchors": [{"kind": "Symbol", "value": "app.a"}, {"kind": "Package", "value": "nothing"}]})["packet"]
    assert len(out["evidence_items"]) == 1 and [u["command"] for u in out["unknowns"]] == ["modules_importing"]
    assert packets.fingerprint(out) == packets.fingerprint(dict(out)) != packets.fingerprint({**out, "user_query": "?"})


def test_scopes(g):  # noqa: F811
    assert packets.repo_scope(g, "O/R", [])["basis"] == "direct_repo_match"
    assert packets.repo_scope(g, "nope", [])["reason"] == "requested_repo_not_owner_qualified"
    assert packets.repo_scope(g, "x/y", [])["status"] == "ambiguous"  # o/r and o/c
    inv = packets.inventory(g)
    assert inv["summary"]["entities"] == g.entities.count() and inv["dependencies"][0] == {"name": "Requests", "importers": 2}
    assert inv["coverage"]["states"] == {"instrumented": 1, "stale": 1} and inv["coverage"]["reasons"] == {"x": 1}
    assert packets.inventory(g, "o/c")["summary"]["entities"] == 1


def test_review(g):  # noqa: F811
    out = packets.review_context(g, "o/r", ["src/app.py", "docs/x.md"], [("src/app.py", 13, 14), ("src/app.py", 200, 201)], include_deploy_blockers=True)
    assert [s["label"] for s in out["changed_symbols"]] == ["app.C"] and [c["subject_label"] for c in out["direct_callers"]] == ["app.d"]
    assert [(a["anchor_type"], a["match_kind"]) for a in out["diff_anchors"]] == [("symbol", "changed_range"), ("file", "range_without_symbol"), ("file", "changed_file_without_range")]
    assert out["review_lead_status"]["coverage_status"] == "useful" and out["unsupported_scopes"] and {s["known_count"] for s in out["surface_status"]} == {0}
    plain = packets.review_context(g, "o/r", ["src/app.py"])
    assert plain["changed_symbols"] == [] == plain["direct_callers"] and len(plain["changed_file_symbols"]) == 3 and plain["answerability"]["status"] == "partial"


def test_planning(g):  # noqa: F811
    fleet = packets.planning_context(g)
    assert fleet["runtime_map"]["services"][0]["service"] == "pay"
    assert packets.planning_context(g, {"symbol": "a"})["answerability"]["missing_fact_families"] == ["ambiguous_anchor"]
    one = packets.planning_context(g, {"symbol": "app.a", "domain": "api", "repo": "o/r"})
    assert one["status"] == "ok" and one["domain"]["reference_count"] == 2 and one["repo"]["authz"]["status"] == "empty"
    assert packets.deploy_blockers_for(g, "o/r")["answerability"]["missing_fact_families"] == ["unsupported_contract"]
    with pytest.raises(ValueError):
        packets.planning_context(g, {"nope": "x"})
