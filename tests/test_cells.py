import math

from stratagraph.operators import cells


def test_dimensions(spark):
    rules = spark.createDataFrame([("web", "import", "Flask"), ("web", "package", "my_pkg"), ("iac", "extension", "tf"), ("data", "import", "pandas")], "dimension string, kind string, value string")
    signals = [("r", "a.py", "import", "flask"), ("r", "a.py", "import", "pandas"), ("r", "b.py", "package", "My-Pkg"), ("r", "m.tf", "extension", "TF"), ("r", "n", "import", "none")]
    out = cells.dimensions(spark.createDataFrame(signals, "repo string, path string, kind string, value string"), rules)
    assert {r.path: r.dimension for r in out.collect()} == {"a.py": "data+web", "b.py": "web", "m.tf": "iac"}


def test_scores_flags_and_fleet(spark):
    rows = []
    for cell, change in ((("r1", "web"), {}), (("r1", "iac"), {"freshness": (0, 4, None)}), (("r2", "web"), {"trust_mix": (1, 0, None)}), (("r3", "web"), {"trust_mix": (1, 2, "stale")})):
        values = dict.fromkeys(cells.MEAN, (1, 2, None)) | {"silent_gap": (1, 4, None), "identity_health": (9, 10, None)} | change
        rows += [(*cell, m, *map(float, v[:2]), v[2]) for m, v in values.items()]
    by = ["repo", "dimension"]
    metrics = cells.metric_rows(spark.createDataFrame(rows, "repo string, dimension string, metric string, part double, whole double, reason string"), by)
    got = {(r.repo, r.dimension): r.score for r in cells.scores(metrics, by).collect()}
    assert math.isclose(got["r1", "web"], 0.5 * 0.75 * 0.9) and got["r1", "iac"] == 0.0 and got["r2", "web"] is None and got["r3", "web"] is None
    said = {(r.repo, r.dimension): r.flags for r in cells.flags(metrics, by).collect()}
    both = ["evidence_grounding:contract_violation", "silent_gap:gap_detected"]
    assert said == {("r1", "web"): both, ("r1", "iac"): both, ("r2", "web"): [*both, "trust_mix:n_a:no_denominator"], ("r3", "web"): [*both, "trust_mix:partial:stale"]}
    out = {(r.grouping, r.name): (r.score, r.cells) for r in cells.fleet(metrics, cells.scores(metrics, by)).collect()}
    assert math.isclose(out["fleet", ""][0], 0.16875) and out["repo", "r1"][1] == 2 and out["dimension", "iac"] == (0.0, 1) and math.isclose(out["metric", "silent_gap"][0], 0.75)
    a = spark.createDataFrame([("r", "1")], "repo string, commit_sha string")
    assert not cells.stale_links(a, a) and cells.stale_links(a, a.where("false"))
