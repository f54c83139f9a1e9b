import numpy as np

from stratagraph.llm import decontamination as d

SF = "/root/testdata/sf0.01"


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], last + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def test_common_subsequence_against_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (rng.integers(0, 5, int(rng.integers(1, 30))).tolist() for _ in range(2))
        assert d.common(a, b) == plain_lcs(a, b)


def test_every_held_item_is_found_and_nothing_else(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    said = {r.doc_id: f" {' '.join(d.words(r.text))} " for r in docs}
    want = {(k, r.item_id) for r in items for k, t in said.items() if f" {' '.join(d.words(r.text))} " in t}
    got = {(r.doc_id, r.item_id) for r in d.op5_latent_decontamination(spark, SF).collect()}
    assert len(want) > 10 and got == want


def test_paraphrases_and_clean_texts(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    items = [" ".join(word() for _ in range(30)) + ". " + " ".join(word() for _ in range(6)) + "." for _ in range(20)]
    filler = lambda n: " ".join(word() for _ in range(n))
    changed = items[0].split()
    for i in range(2, 26, 4):
        changed[i] = word()
    rows = [(1, filler(100) + " " + items[3].upper() + " " + filler(50)), (2, " ".join(changed)), (3, filler(400)), (4, None), (5, ""), (None, items[5]), (1, filler(3))]
    rows += [(100 + i, filler(200)) for i in range(60)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, hits int")
    bench = spark.createDataFrame([*enumerate(items), (77, None), (78, "")], "item_id long, text string")
    out = d.with_hits(docs, bench)
    assert {(r.doc_id, h.item_id) for r in out.collect() for h in r.hits} == {(1, 3), (2, 0), (None, 5)}
    assert out.count() == len(rows) and out.columns == ["doc_id", "text", "hits"]
    assert d.with_hits(docs, bench.where("false")).selectExpr("sum(size(hits))").first()[0] == 0
    assert d.with_hits(docs.where("false"), bench).count() == 0


def test_passages_cover_every_word():
    texts = [np.arange(n, dtype=np.int32) % 7 for n in (0, 1, 31, 32, 33, 64, 65, 200)]
    for overlap in (False, True):
        p = d.passages(texts, np.ones(7, bool), overlap)
        whole = np.bincount(p.text[p.row], p.count, len(texts))
        assert (whole >= [len(t) for t in texts]).all()
        if not overlap:
            assert whole.tolist() == [len(t) for t in texts]


def test_items_of_frequent_words_are_found(spark):
    """Planted in a third of all documents, and in two of ten; whole, with every fifth word changed, and in long texts."""
    rng = np.random.default_rng(7)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 6))
    filler = lambda n: " ".join(word() for _ in range(n))
    items = [filler(24) + ". " + filler(6) + "." for _ in range(20)] + [filler(150) + ". " + filler(6) + "."]
    bench = spark.createDataFrame([*enumerate(items)], "item_id long, text string")
    changed = items[3].split()
    for i in range(0, 24, 5):
        changed[i] = word()
    for n, every, item in ((300, 3, 3), (10, 5, 3), (300, 3, 20)):
        rows = [(i, f"{filler(70)} {items[item]} {filler(90)}" if i % every == 0 else filler(160)) for i in range(n)]
        rows += [(n, " ".join(changed))] if item == 3 else []
        want = {(i, item) for i, _ in rows if i % every == 0 or i == n}
        got = d.with_hits(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
        assert {(r.doc_id, h.item_id) for r in got for h in r.hits} == want


def test_alignment_of_many_against_one_by_one():
    rng = np.random.default_rng(8)
    items = d.Items([*range(30)], [rng.integers(0, 12, int(rng.integers(1, 65))).tolist() for _ in range(30)], [1] * 30, {})
    texts = [rng.integers(-1, 12, int(rng.integers(0, 300))).astype(np.int32) for _ in range(12)]
    for g in d.grouped(items, np.arange(12)):
        text, start, own = g.candidates(texts)
        want = [d.common(g.tokens[o], d.window(texts[x], s, len(g.tokens[o])).tolist()) for x, s, o in zip(text, start, own, strict=True)]
        assert len(want) and g.lcs(texts, text, start, own).tolist() == want
        found = {(int(x), int(s), int(o)) for x, s, o in zip(text, start, own, strict=True)}
        for o, t in enumerate(g.tokens):
            for x, said in enumerate(texts):
                for s in range(0, max(len(said) - d.STRIDE, min(len(said), 1)), d.STRIDE):
                    enough = d.common(t, d.window(said, s, len(t)).tolist()) >= d.LIKELY * len(t)
                    assert not enough or (x, s, o) in found


def test_recall_of_paraphrases_by_rate_of_changed_words(spark):
    """Items in other text, with a share of the words before the answer replaced; clean text beside them."""
    rng = np.random.default_rng(14)
    word = lambda: "".join(rng.choice(list("abcdefghij"), 5))
    items = [" ".join(word() for _ in range(30)) + ". " + " ".join(word() for _ in range(6)) + "." for _ in range(60)]
    filler = lambda n: " ".join(word() for _ in range(n))
    rows, want = [], {}
    for rate in (0.0, 0.1, 0.2, 0.3, 0.4):
        for k, item in enumerate(items):
            said = item.split()
            for i in rng.choice(30, int(30 * rate), replace=False):
                said[i] = word()
            want[len(rows)] = (k, rate)
            rows.append((len(rows), f"{filler(int(rng.integers(0, 150)))} {' '.join(said)} {filler(int(rng.integers(0, 150)))}"))
    clean = range(len(rows), len(rows) + 200)
    rows += [(i, filler(150)) for i in clean]
    out = d.with_hits(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    got = {r.doc_id: {h.item_id for h in r.hits} for r in out.collect()}
    assert not any(got[i] for i in clean)
    recall = {rate: np.mean([k in got[i] for i, (k, r) in want.items() if r == rate]) for rate in (0.0, 0.1, 0.2, 0.3, 0.4)}
    print("recall by rate of changed words:", recall)
    assert recall[0.0] == 1.0 and min(recall.values()) >= 0.9


def test_ties_between_passages_and_blocks_of_items(spark, monkeypatch):
    """A text holds an item twice, two items are equal, and rows are repeated; the benchmark comes in several blocks."""
    rng = np.random.default_rng(15)
    item = " ".join("".join(rng.choice(list("klmnopqr"), 6)) for _ in range(30)) + "."
    docs = [(1, f"{item} {item}"), (1, f"{item} {item}"), (2, item), *((i, " ".join(rng.choice(["x", "y", "z"], 80))) for i in range(3, 40))]
    bench = [(5, item), (6, item), (7, None), (8, "other words that nobody holds at all in this corpus. never.")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for size in (4000, 1):
        monkeypatch.setattr(d, "BLOCK_ITEMS", size)
        rows = d.with_hits(df, spark.createDataFrame(bench, "item_id long, text string")).collect()
        assert sorted((r.doc_id, sorted(h.item_id for h in r.hits)) for r in rows if r.hits) == [(1, [5, 6]), (1, [5, 6]), (2, [5, 6])]
        assert len(rows) == len(docs)
