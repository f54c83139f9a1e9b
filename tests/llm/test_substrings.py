import hashlib

import numpy as np
import pytest

from stratagraph.llm import substrings


def plain(rows, length=50):
    first = {}
    for doc, text in rows:
        b = (text or "").encode()
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            first[s] = min(first.get(s, 2**63), 2**62 if doc is None else doc)
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (2**62 if doc is None else doc):
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in df.collect()), key=str)


def made(seed, n):
    rng = np.random.default_rng(seed)
    words = ["ab", "the", "été", "x", "\0\0", "lorem ipsum", "zz"]
    shared = [" ".join(rng.choice(words, 30)) for _ in range(4)]
    rows = []
    for i in range(n):
        text = " ".join(rng.choice(words, int(rng.integers(0, 60))))
        for _ in range(int(rng.integers(0, 3))):
            s = shared[int(rng.integers(0, 4))]
            cut = int(rng.integers(0, 40))
            text += s[cut : cut + int(rng.integers(20, 160))] + str(int(rng.integers(0, 10)))
        rows.append((i, text))
    return rows + [(3, rows[3][1]), (None, rows[5][1]), (None, rows[5][1] + "!"), (n, None), (n + 1, ""), (n + 2, "a" * 300), (n + 3, "a" * 400)]


@pytest.mark.parametrize("hot", [20_000, 0])
@pytest.mark.parametrize("local_hot", [16, 2, 1])
def test_made_texts_against_brute_force(spark, monkeypatch, hot, local_hot):
    monkeypatch.setattr(substrings, "LOCAL_HOT", (local_hot, local_hot))
    monkeypatch.setattr(substrings, "PACK_BYTES", 6000)
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 1500)
    rows = made(1, 60)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(substrings.without_repeats(df, hot=hot)) == plain(rows)


def test_passage_in_most_documents_with_other_text_around_it(spark, monkeypatch):
    """Each document cuts the passage's runs differently, so that they are compared string by string."""
    rng = np.random.default_rng(4)
    passage = " ".join(rng.choice(["river", "stone", "cloud", "lamp", "seven", "quiet"], 40))
    rows = [(int(i), f"{rng.integers(10**9)}{passage[int(rng.integers(0, 9)):]}{rng.integers(10**9)}" * int(rng.integers(1, 3))) for i in rng.permutation(150)]
    monkeypatch.setattr(substrings, "PACK_BYTES", 4000)
    monkeypatch.setattr(substrings, "LOCAL_HOT", (8, 8))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert got(substrings.without_repeats(df)) == plain(rows)


def test_an_entry_a_pack_for_the_many_classes_of_one_hash():
    rng = np.random.default_rng(4)
    passage = " ".join(rng.choice(["river", "stone", "cloud", "lamp", "seven", "quiet"], 40))
    import pyarrow as pa

    texts = [f"{rng.integers(10**9)}{passage}{rng.integers(10**9)}" for _ in range(200)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(200), pa.int64()), pa.array(texts, pa.string())], names=["a", "b"])
    (packed,) = substrings._packed(iter([batch]))
    pack = substrings.Pack(*(packed.column(k)[0].as_py() for k in range(3)), 16)
    assert np.unique(pack.least[pack.entries], return_counts=True)[1].max() < 16
    assert np.unique(pack.least, return_counts=True)[1].max() > 150


def test_documents_against_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    assert got(substrings.without_repeats(docs)) == plain(rows)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, n_bytes string")
    assert substrings.without_repeats(df).count() == 0


def test_classes_are_equal_strings():
    rng = np.random.default_rng(0)
    for size in (1, 30, 500):
        body = bytes(rng.integers(97, 99, size).astype(np.uint8)) * 2
        classes = substrings.string_classes(body, 50)
        text = body + bytes(60)
        seen = {}
        for i in range(len(body) - 49):
            assert seen.setdefault(text[i : i + 50], classes[i]) == classes[i]
        assert len(set(seen.values())) == len(seen)


def test_blocks_cut_between_documents(monkeypatch):
    import pyarrow as pa

    rows = [r for r in made(2, 20) if r[0] is not None]
    batch = pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["a", "b"])
    (packed,) = substrings._packed(iter([batch]))
    packs = []
    for size in (500, 1 << 20):
        monkeypatch.setattr(substrings, "BLOCK_BYTES", size)
        packs.append(substrings.Pack(*(packed.column(k)[0].as_py() for k in range(3)), 16))
    a, b = packs
    assert len(a.blocks) > 3 and len(b.blocks) == 1
    assert a.raw == b"".join((r[1] or "").encode() for r in rows) and a.ids.tolist() == [r[0] for r in rows]
    for name in ("start", "count", "doc", "of", "least", "content", "first", "leads"):
        assert getattr(a, name).tolist() == getattr(b, name).tolist()


@pytest.mark.parametrize("hot", [20_000, 0])
def test_buckets_are_compared_by_parts(monkeypatch, hot):
    """However large a bucket is, little more than COMPARED_BYTES of it are sorted at once."""
    import pyarrow as pa
    import pyarrow.compute  # noqa: F401

    monkeypatch.setattr(substrings, "PACK_BYTES", 6000)
    monkeypatch.setattr(substrings, "COMPARED_BYTES", 3000, raising=False)
    sorted_, classes = [], substrings.string_classes
    monkeypatch.setattr(substrings, "string_classes", lambda body, length: sorted_.append(len(body)) or classes(body, length))
    rows = made(3, 150)
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.string()))], names=["a", "b"])
    packs = pa.Table.from_batches(substrings._packed(iter([batch])))
    packs = packs.append_column("pack", pa.array(range(len(packs)), pa.int64()))
    judged = substrings._judge(pa.Table.from_batches(substrings._entries(1, 4)(iter(packs.to_batches()))), hot)
    verdicts = {r["pack"]: [r] for r in judged.to_pylist()}
    packs = packs.append_column("verdicts", pa.array([verdicts.get(k) for k in range(len(packs))]))
    contents = pa.Table.from_batches(substrings._contents(1, 4)(iter(packs.to_batches())))
    marks = substrings._compared(contents.filter(pa.compute.equal(contents["bucket"], 0)))
    assert sum(sorted_) > 40_000 and max(sorted_) < sum(sorted_) / 4
    marks = {r["pack"]: [r["marks"]] for r in marks.to_pylist()}
    own = contents.filter(pa.compute.equal(contents["bucket"], substrings.OWN)).select(["settled", "lone"])
    whole = pa.table([*packs.columns, *own.columns, pa.array([marks.get(k) for k in range(len(packs))], pa.list_(pa.binary()))], [*packs.column_names, "settled", "lone", "marks"])
    out = [tuple(r.values()) for b in substrings._removed(iter(whole.combine_chunks().to_batches())) for r in b.to_pylist()]
    assert sorted(((*r[:4], hashlib.sha256(r[4]).hexdigest()) for r in out), key=str) == plain(rows)


def test_clashing_columns(spark):
    rows = [(1, "a" * 60, 1), (2, "a" * 60, 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, pack int")
    assert got(substrings.without_repeats(df)) == plain([r[:2] for r in rows])
