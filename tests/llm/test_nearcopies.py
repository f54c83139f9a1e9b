import numpy as np

from stratagraph.llm import nearcopies as nc


def sets(rows, width=5):
    out = []
    for _, t in rows:
        w = (t or "").lower().split()
        out.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set())
    return out


def plain(rows):
    """One id of each component of texts with similarity 0.8; rows are in the order of their ids."""
    found, root = sets(rows), list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            same = len(found[i] & found[j])
            if same >= 0.8 * (len(found[i]) + len(found[j]) - same):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sorted(rows[i][0] for i in range(len(rows)) if find(i) == i)


def made(seed, n):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(3000)]
    rows = []
    for k in range(n):
        text = list(rng.choice(words, int(rng.integers(3, 300))))
        rows.append((len(rows), " ".join(text)))
        for _ in range(int(rng.integers(0, 6))):
            copy = list(text)
            for _ in range(int(rng.integers(0, 1 + len(text) // 40))):
                copy[int(rng.integers(0, len(copy)))] = str(rng.choice(words))
            if rng.random() < 0.3:
                copy += list(rng.choice(words, len(copy) // 12))
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_components_against_brute_force(spark):
    rows = made(1, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got, want = sorted(r.doc_id for r in nc.one_of_each(df).collect()), plain(rows)
    assert len(want) < 0.6 * len(rows)
    assert len(set(got) ^ set(want)) <= 0.01 * len(rows)  # what the index and the estimate may miss


def test_large_groups_against_brute_force(spark, monkeypatch):
    """Groups far over a block, with texts between them that belong to one, to both or to none."""
    rng = np.random.default_rng(9)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(2):
        text = base[: 300 - 45 * g] + [f"g{g}x{i}" for i in range(45 * g)]
        for _ in range(40):
            copy = list(text)
            for _ in range(int(rng.integers(0, 8))):
                copy[int(rng.integers(0, len(copy)))] = f"o{int(rng.integers(10**6))}"
            rows.append((len(rows), " ".join(copy)))
    rows += [(len(rows) + i, " ".join(rng.choice(base, 200))) for i in range(20)]
    monkeypatch.setattr(nc, "BLOCK", 6)
    got = sorted(r.doc_id for r in nc.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == plain(rows) and len(got) < 30


def test_documents_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in nc.one_of_each(df).collect()) == plain(rows)


def test_lists_dealt_out_by_blocks(spark, monkeypatch):
    rng = np.random.default_rng(3)
    text = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):
        copy = list(text)
        copy[int(rng.integers(0, 200))] = f"x{i}"
        rows.append((i, " ".join(copy)))
    monkeypatch.setattr(nc, "BLOCK", 5)
    assert [r.doc_id for r in nc.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]


def test_spanning_forest_is_the_greatest():
    rng = np.random.default_rng(0)
    for n in (1, 2, 9, 30):
        x = rng.random((n, n))
        x = (x + x.T) / 2
        links = nc.spanning(n, lambda k, rest, x=x: x[k, rest], 0.0)
        assert len(links) == n - 1
        for limit in (0.4, 0.6, 0.8):
            def classes(pairs, n=n):
                root = list(range(n))
                for a, b in pairs:
                    ra, rb = root[a], root[b]
                    root = [min(ra, rb) if r in (ra, rb) else r for r in root]
                return root

            assert classes([(a, b) for a, b, v in links if v >= limit]) == classes([(i, j) for i in range(n) for j in range(i) if x[i, j] >= limit])


def test_nulls_repeats_clashes_and_empty(spark):
    rows = [(1, "a b c d e f", "x"), (2, "a b c d e f", None), (2, "a b c d e f", None), (None, None, "y"), (None, "", None), (3, "q r s t u v", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __fp string")
    left = nc.one_of_each(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id or -1, r.text or "") for r in left.collect()) == [(-1, ""), (1, "a b c d e f"), (3, "q r s t u v")]
    assert nc.one_of_each(df.where("false")).count() == 0


def test_true_link_that_the_forest_displaces(spark, monkeypatch):
    """Of three texts in one list the first is similar to the second only, but its estimate with the third is greater."""
    rng = np.random.default_rng(6)

    def trio(g):
        core, new = [f"g{g}w{i}" for i in range(500)], [f"g{g}n{i}" for i in range(40)]
        third = list(core)
        for i in rng.integers(0, 434, 2):
            third[int(i)] = "x"
        return [(k, " ".join(t)) for k, t in enumerate((core[:434] + new, core[:434] + new[:2] + core[436:], third))]

    def displaced(rows):
        found = [nc.shingles(t, 5) for _, t in rows]
        fp = np.array([np.frombuffer(nc.fingerprint(s), np.uint64) for s in found])
        first, second = nc.similarity(fp[0], len(found[0]), fp[1:], np.array([len(s) for s in found[1:]]))
        return len(set((fp[:, 0] & np.uint64(255)).tolist())) == 1 and second > first >= nc.SIMILAR - nc.MARGIN

    monkeypatch.setattr(nc, "PAIRS", ((0, 0),))  # all that share the first byte are one list
    rows = next(r for r in map(trio, range(5000)) if displaced(r))
    assert plain(rows) == [0] and plain([rows[0], rows[2]]) == [0, 2]
    assert [r.doc_id for r in nc.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()] == [0]


def test_index_and_estimate_at_the_limit():
    """Sets of 400 shared and 50 + 50 other shingles, similarity exactly 0.8: most pairs meet and are estimated near it."""
    rng = np.random.default_rng(12)
    met = 0
    for _ in range(300):
        both, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (400, 50, 50))
        fp = [np.frombuffer(nc.fingerprint(np.unique(np.concatenate([both, x]))), np.uint64) for x in (a, b)]
        same = fp[0].view(np.uint8) == fp[1].view(np.uint8)
        listed = any(same[p] and same[q] for p, q in nc.PAIRS)
        head = [f[: nc.INDEX_BYTES // 8] for f in fp]
        met += listed and bool(nc.loosely(head[0], head[1][None])[0]) and nc.similarity(fp[0], 450, fp[1][None], np.array([450]))[0] >= nc.SIMILAR - nc.MARGIN
    assert met >= 0.97 * 300
