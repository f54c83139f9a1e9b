import os
import warnings

import numpy as np
import pytest

from stratagraph.llm import mixing

SF = "/root/testdata/sf0.01"


def test_expected_tokens_meet_the_targets(spark):
    rows = mixing.op1_soft_mixing(spark, SF).collect()
    n, rate = (np.array([r[k] for r in rows], float) for k in ("n_tokens", "rate"))
    p = np.array([[r[f"p_{d}"] for d in mixing.DOMAINS] for r in rows])
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert (rate >= 0).all() and np.abs(p.sum(axis=1) - 1).max() < 1e-9
    assert np.abs((rate * n) @ p / n.sum() - mixing.TARGETS).max() < 1e-3


def test_steps_reach_the_nearest_rates(spark):
    """Against the minimum-change solution in closed form, while no rate is cut at 0."""
    rng = np.random.default_rng(0)
    p = rng.dirichlet([2, 2, 2], 50)
    n = rng.integers(1, 100, 50)
    rows = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n_tokens long, posterior array<double>")
    goal = n @ p / n.sum() + [0.03, -0.02, -0.01]
    got = mixing.rates(p, mixing.fit_rates(rows, tuple(goal)))
    gram = (p * n[:, None]).T @ p / n.sum()
    want = 1 - p @ np.linalg.solve(gram, n @ p / n.sum() - goal)
    assert (want > 0).all() and np.allclose(got, want, atol=1e-5)


def test_nulls_repeats_clashes_and_empty(spark):
    docs = spark.createDataFrame([(1, "a b c", 5), (1, "a b c", 5), (None, None, 6), (2, "", 7)], "doc_id long, text string, rate int")
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    out = mixing.with_rates(docs, labels).collect()
    assert len(out) == 4 and len({r.rate for r in out if r.doc_id == 1}) == 1
    kept = mixing.resampled(docs, labels)
    assert kept.columns == docs.columns and mixing.resampled(docs.where("false"), labels).count() == 0
    assert mixing.with_rates(docs, labels.where("false")).count() == 4


def test_targets_are_met_when_rates_are_cut_at_zero(spark):
    """Corpora far from the targets, with undecided posteriors; unreachable targets are reported."""
    rng = np.random.default_rng(1)
    for shares in ((0.6, 0.3, 0.1), (0.5, 0.1, 0.4), (0.1, 0.2, 0.7)):
        domain = rng.choice(3, 600, p=shares)
        p = np.array([rng.dirichlet(0.6 + 3 * np.eye(3)[d]) for d in domain])
        n = rng.integers(1, 400, 600)
        rows = spark.createDataFrame([(int(a), b.tolist()) for a, b in zip(n, p, strict=True)], "n_tokens long, posterior array<double>")
        with warnings.catch_warnings():
            warnings.simplefilter("error", UserWarning)
            rate = mixing.rates(p, mixing.fit_rates(rows, mixing.TARGETS))
        assert (rate == 0).any() and np.abs((rate * n) @ p / n.sum() - mixing.TARGETS).max() <= 1.01 * mixing.CLOSE
    rows = spark.createDataFrame([(10, [0.5, 0.3, 0.2]), (10, [0.4, 0.3, 0.3])], "n_tokens long, posterior array<double>")
    with pytest.warns(UserWarning, match="off by"):
        assert np.isfinite(mixing.fit_rates(rows, mixing.TARGETS)).all()


def test_the_driver_gets_the_model_alone(spark, monkeypatch):
    """The classifier is trained in another process, on the rows in the order of their ids, and equals one trained here."""
    texts = {k: ("bad worse worst " if k % 3 == 2 else "fine good better ") * (1 + k % 5) + "x" * (k % 3) for k in range(30)}
    docs = spark.createDataFrame([(k, texts[k]) for k in sorted(texts, key=lambda k: k * 7 % 30)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0), int(k % 3 == 2)) for k in texts], "doc_id long, quality int, toxic int")
    want = mixing.train([texts[k] for k in range(30)], [k % 3 for k in range(30)])
    got = mixing.fit_domains(docs, labels)
    for a, b in ((got.toxic, want.toxic), (got.poor, want.poor)):
        assert np.array_equal(a.value, b.value) and a.bias == b.bias
    monkeypatch.setattr(mixing, "train", lambda texts, domain: (os.getpid(), texts, domain))
    assert mixing.fit_domains(docs, labels)[0] != os.getpid()
    assert mixing.fit_domains(docs, labels)[1:] == ([texts[k] for k in range(30)], [k % 3 for k in range(30)])
