import numpy as np
import pytest

import corpus_pipeline
from stratagraph.llm import decontamination, repetition, scratch

from .test_nearcopies import plain

SF = "/root/testdata/sf0.001"


def test_stages_are_the_agreed_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontaminate", "mix", "shards"]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = f"file://{tmp_path_factory.mktemp('stages')}/{name}"
        stage(spark, out[-1], SF).write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_each_stage_against_its_operator_by_brute_force(steps):
    rows = [[(r.doc_id, r.text) for r in s.select("doc_id", "text").collect()] for s in steps]
    for before, after in zip(steps[:4], steps[1:5], strict=True):
        assert after.columns == before.columns

    def good(text):
        n, _, _, _, repeated, covered, longest = repetition.measure([text])[0]
        return n >= 50 and 100 * repeated <= 50 * n and 100 * covered <= 30 * n and longest <= 150

    assert sorted(rows[1]) == sorted(r for r in rows[0] if good(r[1]))
    assert sorted(d for d, _ in rows[2]) == plain(sorted(rows[1]))
    items = [(r.item_id, decontamination.words(r.text)) for r in steps[0].sparkSession.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = lambda text: any(f" {' '.join(w)} " in f" {' '.join(decontamination.words(text))} " for _, w in items)
    assert sum(holds(t) for _, t in rows[2]) > 0
    assert {d for d, t in rows[3]} == {d for d, t in rows[2] if not holds(t)}
    assert {d for d, _ in rows[4]} <= {d for d, _ in rows[3]}
    assert sorted(rows[5], key=str) == sorted(rows[4], key=str)


def test_shards_are_contiguous_and_gapless(steps):
    rows = steps[5].orderBy("shard", "slot").select("doc_id", "shard", "slot").collect()
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in rows)
    for s in {r.shard for r in rows}:
        assert [r.slot for r in rows if r.shard == s] == list(range(sum(r.shard == s for r in rows)))


def test_run_gives_the_same_and_cleans_up(spark, steps):
    got = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, got.select("doc_id", "shard", "slot").collect())) == sorted(map(str, steps[5].select("doc_id", "shard", "slot").collect()))
    assert len([p for p, s in scratch._made.items() if s.startswith("run-")]) <= 4


def test_empty_nulls_repeats_and_other_columns(spark, tmp_path):
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    rows = spark.read.parquet(f"{SF}/documents.parquet").limit(40).selectExpr("*", "'x' AS shard", "1 AS hits", "2 AS rate")
    odd = rows.limit(3).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "text", "lang", "source", "n_chars", "shard", "hits", "rate")
    none = rows.limit(2).selectExpr("doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "n_chars", "shard", "hits", "rate")
    for k, df in enumerate((rows.union(odd).union(none).union(rows), rows.where("false"))):
        df.write.parquet(f"{tmp_path}/{k}/documents.parquet")
        for t in ("benchmark", "labels"):
            spark.read.parquet(f"{tmp_path}/{t}.parquet").write.parquet(f"{tmp_path}/{k}/{t}.parquet")
        out = corpus_pipeline.run(spark, f"{tmp_path}/{k}")
        assert set(out.columns) >= {"doc_id", "text", "hits", "rate", "shard", "slot"}
        assert (out.count() == 0) == (k == 1)


def test_very_long_texts_and_ties(spark, tmp_path):
    """A long text, and copies under equal ids, go through every stage once."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(40_000)]
    long = " ".join(rng.permutation(words))
    other = " ".join(rng.permutation(words)[:300])
    rows = [(1, long), (2, long), (2, other), (2, other), (3, other + " end")]
    docs = spark.createDataFrame([(*r, "en", "s", len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("benchmark", "labels"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    kept = corpus_pipeline.near_duplicates(spark, corpus_pipeline.quality(spark, docs, str(tmp_path)), str(tmp_path))
    assert sorted((r.doc_id, len(r.text)) for r in kept.collect()) == [(1, len(long)), (2, len(other))]
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in out.select("doc_id").collect()} <= {1, 2}
