import re

import numpy as np
import xxhash

from stratagraph.llm import simhash


def plain(text, width):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", lower) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + width]) for i in range(len(words) - width + 1)] or [" ".join(words)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = sorted(set(fps))
    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def check(rows, got, width):
    fps = {i: plain(t, width) for i, t in rows}
    comp = plain_components(fps.values())
    least = {}
    for i, f in fps.items():
        least[comp[f]] = min(least.get(comp[f], i), i)
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{f:016x}", least[comp[f]]) for i, f in fps.items()}


def test_documents_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    rows += [(10_000, ""), (10_001, " \t"), (10_002, "One two"), (10_003, "one TWOİ  "), (10_004, "a b c"), (10_005, "a b  c")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    check(rows, simhash.op3_simhash_bytes(spark, str(tmp_path)).collect(), 3)


def test_links_connect_what_is_near(spark, monkeypatch):
    rng = np.random.default_rng(3)
    made = set(rng.integers(0, 2**64, 40, dtype=np.uint64).tolist())
    for f in list(made):
        for _ in range(30):
            for b in rng.integers(0, 64, 2):
                f ^= 1 << int(b)
            made.add(f)
    fps = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in made], "fp long")
    for block in (2048, 7):
        monkeypatch.setattr(simhash, "BLOCK", block)
        found = simhash.links(fps).collect()
        root = {f: f for f in made}

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        for r in found:
            a, b = r.a % 2**64, r.b % 2**64
            assert (a ^ b).bit_count() <= 3
            root[find(a)] = find(b)
        want = plain_components(made)
        classes = lambda f: {frozenset(x for x in made if f(x) == r) for r in set(map(f, made))}
        assert classes(find) == classes(want.get)


def test_null_ids_repeats_and_empty(spark, tmp_path):
    rows = [(None, "a b c d"), (None, "a b c d"), (7, None), (7, None), (None, "x y z w")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for k, part in enumerate((df, df.where("false"))):
        part.write.parquet(f"{tmp_path}/{k}/documents.parquet")
    got = simhash.op3_simhash_bytes(spark, f"{tmp_path}/0").collect()
    assert sorted((r.doc_id or 0, r.component_id or 0, r.fingerprint == "0" * 16) for r in got) == [(0, 0, False)] * 3 + [(7, 7, True)] * 2
    assert simhash.op3_simhash_bytes(spark, f"{tmp_path}/1").count() == 0


def test_clashing_columns_are_replaced(spark):
    df = spark.createDataFrame([(1, "a b c d", "x")], "doc_id long, text string, FP string")
    out = simhash.with_fingerprint(df, "text", 3, "fp")
    assert out.columns == ["doc_id", "text", "fp"] and out.first().fp == np.uint64(plain("a b c d", 3)).view(np.int64)
