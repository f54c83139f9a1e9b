import math
import zlib

import numpy as np

from stratagraph.llm import toxicity

SF = "/root/testdata/sf0.1"


def test_held_out_accuracy(spark):
    rows = toxicity.op2_subword_toxicity(spark, SF).collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == (r.score >= 0.3) for r in rows)
    test = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    recall = np.mean([p for p, y in test if y])
    false = np.mean([p for p, y in test if not y])
    assert recall >= 0.9 and false <= 0.02


def test_unseen_misspellings_share_grams():
    clean = [f"the quiet river number {i} flows past hills" for i in range(60)]
    bad = [f"the quiet idiot number {i} flows past hills" for i in range(60)]
    model = toxicity.train(clean + bad, [0] * 60 + [1] * 60, [1.0] * 120)
    score = toxicity.scores(["a idiottt flows", "a river flows", "", None], model)
    assert score[0] > 0.5 > score[1] and score[2] == score[3]


def plain_score(text, model):
    """The score by loops over words and their n-grams, with the hash in whole numbers."""
    words, word = [], ""
    for c in (text or "").lower() + " ":
        if c.isalnum():
            word += c
        elif word:
            words, word = [*words, word], ""
    means = []
    for w in words:
        marked, found = "\1" + w + "\1", []
        for i in range(len(marked)):
            h = ord(marked[i]) * 2654435761 % 2**32
            for n in range(2, toxicity.GRAMS[1] + 1):
                if i + n > len(marked):
                    break
                h = (h ^ (ord(marked[i + n - 1]) + n)) * 2246822519 % 2**32
                h ^= h >> 13
                if n >= toxicity.GRAMS[0]:
                    found.append(float(model.value[h * 3266489917 % 2**32 >> 32 - toxicity.BITS]))
        means.append(sum(found) / len(found))
    return 1 / (1 + math.exp(-(sum(means) / len(means) if means else 0) - model.bias))


def test_scores_against_plain_loops(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    model = toxicity.fit(docs, spark.read.parquet("/root/testdata/sf0.001/labels.parquet"))
    assert np.count_nonzero(model.value) > 10_000  # every n-gram of the sample has a vector
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, "a"), (-4, "été été, 'x9'"), (-5, "ab " * 3000), (-6, "--")], docs.schema)
    rows = toxicity.with_score(docs.union(odd), model).collect()
    assert max(abs(r.score - plain_score(r.text, model)) for r in rows) < 1e-6


def test_a_rare_word_counts_a_little_and_a_frequent_one_much():
    rng = np.random.default_rng(3)
    words = [f"word{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words, 30)) for _ in range(1000)]
    labels = [int(i < 200) for i in range(1000)]
    texts = [t + " zorbflax" * (i < 3) + " grimblot" * (i < 120) for i, t in enumerate(texts)]
    model = toxicity.train(texts, labels, [1.0] * 1000)
    plain, rare, frequent = toxicity.scores(["word1 word2", "word1 zorbflax", "word1 grimblot"], model)
    assert plain < rare < frequent and frequent > 0.8


def test_bounded_sample(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "MAX_BYTES", 5)
    docs = spark.createDataFrame([(1, "b"), (1, "a"), (2, "too long"), (3, None), (None, "x")], "doc_id long, text string")
    sample = spark.createDataFrame([(1, 0), (2, 1), (3, 1)], "doc_id long, toxic int")
    assert sorted((r.doc_id, r.text) for r in toxicity.taught(docs, sample, "toxic").collect()) == [(1, "a"), (3, None)]


def test_grams_are_those_of_marked_words():
    g = toxicity.grams(["Ab, cd!x", "", None, "é"])
    assert g.per_text.tolist() == [3, 0, 0, 1]
    assert g.per_word.tolist() == [2 + 1, 2 + 1, 1, 1]  # <ab ab> <ab>; <x>
    assert (g.bucket < toxicity.BUCKETS).all()


def test_without_rows_or_one_class(spark):
    assert toxicity.train([], [], []).value.any() == np.False_
    docs = spark.createDataFrame([(1, "a b", "s"), (None, None, None), (1, "a b", "s")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1), (1, None), (None, 1), (7, 0)], "doc_id long, toxic int")
    out = toxicity.with_score(docs, toxicity.fit(docs, labels))
    assert out.count() == 3 and dict(out.dtypes)["score"] == "double"
    assert toxicity.with_score(docs.where("false"), toxicity.fit(docs.where("false"), labels)).count() == 0
