import json

import pytest

from stratagraph.operators import cells
from stratagraph.plans import reports
from stratagraph.sources import org

REPOS = [{"name": n, "full_name": f"o/{n}", "clone_url": f"https://h/o/{n}"} for n in ("api", "web", "old-x")]


def test_sync_goes_on_and_build_skips(tmp_path):
    home = str(tmp_path / "home")
    org.init(home, provider="forge", org="o", exclude=["old-*"])
    commits = {"o/api": "1", "o/web": "1"}

    def fetch(repo, folder):
        if commits[repo["full_name"]] is None:
            raise OSError("gone")
        return commits[repo["full_name"]]

    assert org.sync(home, REPOS, fetch) == {"repos": 2, "changed": 2, "unchanged": 0, "failed": 0, "errors": []}
    made = []

    def make(folders, out):
        made.append(folders)
        (tmp_path / "home" / "snapshot").mkdir(exist_ok=True)
        (tmp_path / "home" / "snapshot" / "manifest.json").write_text("{}")
        return {}

    assert not org.build(home, make)["skipped"] and org.build(home, make)["skipped"] and not org.build(home, make, force=True)["skipped"]
    commits |= {"o/api": "2", "o/web": None}
    out = org.sync(home, REPOS, fetch)
    assert (out["changed"], out["unchanged"], out["failed"]) == (1, 0, 1)
    _, state = org.load(home)
    assert [(r["full_name"], r["commit_sha"]) for r in state["repos"]] == [("o/api", "2"), ("o/web", "1")] and state["last_sync_errors"][0]["error"] == "OSError"
    assert not org.build(home, make)["skipped"] and len(made) == 3
    with pytest.raises(OSError):
        org.sync(home, REPOS, fetch, go_on=False)


def test_what_is_chosen_and_refused(tmp_path):
    config = org.checked({"provider": "p", "org": "o", "include": ["o/a*", "web"]})
    assert [r["name"] for r in org.chosen(REPOS, config)] == ["api", "web"]
    for bad in ({"org": "o"}, {"provider": "p", "org": "o", "include": "x"}, {"provider": "p", "org": "o", "clone_protocol": "ftp"}):
        with pytest.raises(ValueError):
            org.checked(bad)
    org.init(str(tmp_path), provider="p", org="o")
    with pytest.raises(ValueError):
        org.build(str(tmp_path), lambda *_: {})
    assert org.commit_of(str(tmp_path)) == "unknown" or len(org.commit_of(str(tmp_path))) == 40


def test_metric_configuration():
    assert reports.metric_config()["enabled_metrics"] == reports.METRICS
    got = reports.metric_config("enabled_metrics: [trust_mix]\nfreshness: {default_days: 9}\ntrust_weights: {candidate: 0.5}\n")
    assert got == {"enabled_metrics": ("trust_mix",), "freshness_days": 9, "trust_weights": {"candidate": 0.5}}
    for bad in ("[]", "enabled_metrics: []", "enabled_metrics: [x]", "enabled_metrics: [trust_mix, trust_mix]", "enabled_metrics: [trust_mix]\nfreshness: {default_days: 0}",
                "enabled_metrics: [trust_mix]\ntrust_weights: {candidate: 2}", "enabled_metrics: [trust_mix]\ntrust_weights: {odd: 1}"):
        with pytest.raises(ValueError):
            reports.metric_config(bad)


def test_report_baseline_and_deltas(spark, tmp_path):
    rows = [("r", "web", m, 1.0, 2.0, None) for m in (*cells.MEAN, *cells.SCALE)]
    metrics = cells.metric_rows(spark.createDataFrame(rows, "repo string, dimension string, metric string, part double, whole double, reason string"), ["repo", "dimension"])
    gaps = spark.createDataFrame([("c1", "stale")], "coverage_id string, state string")
    payload = reports.report(metrics, gaps, "run1", 3)
    assert payload["cells"][0]["score"] == 0.125 and "silent_gap:gap_detected" in payload["cells"][0]["flags"] and len(payload["worst_metrics"]) == 5
    made, shown = reports.write_report(payload, str(tmp_path / "out"))
    assert json.loads(open(made).read())["run_id"] == "run1" and "| r | web | 0.125 |" in open(shown).read()
    ents = spark.createDataFrame([("e", "Repo"), ("f", "Repo")], "entity_id string, kind string")
    facts = spark.createDataFrame([("x", "CALLS")], "fact_id string, predicate string")
    coverage = spark.createDataFrame([("c", {"reason": "a"}), ("d", {})], "coverage_id string, scope_ref map<string,string>")
    base = reports.baseline({"entities": ents, "facts": facts, "coverage": coverage}, "b")
    assert base["entity_kind_counts"] == {"Repo": 2} and base["coverage_reason_counts"] == {"a": 1, "unknown": 1}
    assert reports.drifted(base, {**base, "entity_kind_counts": {"Repo": 1}}) == [("entity_kind_counts", "Repo", 2, 1)]
    deltas = spark.createDataFrame([("q1", "plan", 0.0625), ("q2", "plan", None), ("q3", "code", 2.0)], "task string, phase string, calls_saved double")
    assert reports.write_deltas(deltas, str(tmp_path / "d.jsonl")) == {"code": {"count": 1, "calls_saved": 2.0}, "plan": {"count": 2, "calls_saved": 0.062}}
    assert len((tmp_path / "d.jsonl").read_text().splitlines()) == 3


def test_cells_by_files(spark):
    facts = spark.createDataFrame([("f1", "a", "b"), ("f2", "c", "d")], "fact_id string, subject_id string, object_id string")
    seen = spark.createDataFrame([("entity", "b", "r@c:x.py"), ("fact", "f2", "r@c:y.py"), ("entity", "z", "r@c:no")], "target_type string, target_id string, key string")
    files = spark.createDataFrame([("web", "r@c:x.py"), ("iac", "r@c:y.py")], "dimension string, key string")
    ents, inside = reports.scoped(facts, seen, files)
    assert [tuple(r) for r in ents.collect()] == [("web", "b")]
    assert sorted(tuple(r) for r in inside.collect()) == [("iac", "f2"), ("web", "f1")]
