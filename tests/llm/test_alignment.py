import hashlib
from difflib import SequenceMatcher

import numpy as np

from stratagraph.llm import alignment


def patience(a, b, a0=0, b0=0):
    """A patience diff by recursion on lists: the places of ``b`` that it aligns."""
    out, head = set(), 0
    while head < min(len(a), len(b)) and a[head] == b[head]:
        out.add(b0 + head)
        head += 1
    a, b, a0, b0 = a[head:], b[head:], a0 + head, b0 + head
    while a and b and a[-1] == b[-1]:
        out.add(b0 + len(b) - 1)
        a, b = a[:-1], b[:-1]
    once = [x for x in b if a.count(x) == 1 and b.count(x) == 1]
    if not once:
        return out
    # the longest rising run of places in a, by dynamic programming; of equally long ones that of the piles
    at = [a.index(x) for x in once]
    assert len(set(at)) == len(at)
    tails, back = [], {}
    for k, i in enumerate(at):
        pile = sum(1 for t in tails if at[t] < i)
        back[k] = tails[pile - 1] if pile else None
        tails[pile : pile + 1] = [k]
    k, run = tails[-1], []
    while k is not None:
        run.append(once[k])
        k = back[k]
    la, lb = 0, 0
    for x in [*run[::-1], None]:
        ia, ib = (a.index(x), b.index(x)) if x is not None else (len(a), len(b))
        out |= patience(a[la:ia], b[lb:ib], a0 + la, b0 + lb)
        if x is not None:
            out.add(b0 + ib)
        la, lb = ia + 1, ib + 1
    return out


def plain(rows):
    """Every pair of documents that share a line, aligned; rows are (doc_id, text) in order."""
    place = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, i))
    parts = [(t or "").split("\n") for _, t in rows]
    said = [[j for j, x in enumerate(p) if x.strip(" \t\n\x0b\x0c\r")] for p in parts]
    first, gone, single = {}, {i: set() for i in range(len(rows))}, []
    for i in place:
        if first.setdefault(rows[i][1] or "", i) == i:
            mine = [parts[i][j] for j in said[i]]
            for e in single:
                theirs = [parts[e][j] for j in said[e]]
                if set(mine) & set(theirs):
                    gone[i] |= {said[i][k] for k in patience(theirs, mine)}
            single.append(i)
        elif said[i]:
            gone[i] = set(range(len(parts[i])))
    out = []
    for i, (doc, _) in enumerate(rows):
        if gone[i]:
            for j in set(range(len(parts[i]))) - set(said[i]):
                near = [max((k for k in said[i] if k < j), default=None), min((k for k in said[i] if k > j), default=None)]
                if all(k is None or k in gone[i] for k in near):
                    gone[i].add(j)
        blocks = sum(1 for j in gone[i] if j - 1 not in gone[i])
        kept = "\n".join(p for j, p in enumerate(parts[i]) if j not in gone[i])
        out.append((doc, len(parts[i]), len(gone[i]), blocks, hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_lines, r.n_removed, r.n_blocks, hashlib.sha256(r.kept.encode()).hexdigest()) for r in df.collect()), key=str)


def test_made_documents_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    pool = [f"line {i}" for i in range(60)] + ["common"] * 20 + ["", " "]
    rows = [(i, "\n".join(rng.choice(pool, int(rng.integers(1, 9))))) for i in range(80)]
    rows += [(80, rows[3][1]), (80, rows[3][1]), (None, rows[3][1]), (None, "line 1\nline 2\nnew"), (81, None), (82, ""), (83, "\n\n")]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert got(alignment.without_common_blocks(df)) == plain(rows)


def test_lines_that_most_documents_hold_against_all_pairs(spark, monkeypatch):
    """Few lines in any order, often twice in a text: many pairs are needed to settle a line."""
    rng = np.random.default_rng(8)
    rows = [(i, "\n".join(rng.choice([f"c{k}" for k in range(9)] + [f"own {i}"] * 3, int(rng.integers(2, 7))))) for i in range(120)]
    monkeypatch.setattr(alignment, "HOLDERS", 7)
    monkeypatch.setattr(alignment, "PARTNERS", 5)
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert got(alignment.without_common_blocks(df)) == plain(rows)


def test_documents_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").coalesce(1)
    rows = [tuple(r) for r in docs.collect()]
    want = plain(rows)
    assert got(alignment.without_common_blocks(docs)) == want
    assert any(r[2] for r in want) and any(not r[2] for r in want)


def test_fate_of_a_line_is_the_same_however_many_hold_it(spark):
    """The first holder has the two lines in the other order, so that only the second one can take both."""
    for others in (7, 9, 30):
        rows = [(0, "second\nown\nfirst")] + [(i, f"head {i}\nfirst\nsecond\ntail {i}") for i in range(1, others + 1)]
        left = {r.doc_id: r.n_removed for r in alignment.without_common_blocks(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert left == {0: 0, 1: 1} | dict.fromkeys(range(2, others + 1), 2)


def test_aligned_lines_are_common_to_both():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a, b = ([int(x) for x in rng.integers(1, 12, int(rng.integers(0, 12)))] for _ in range(2))
        found = alignment.aligned(a, b)
        assert set(found) == patience(a, b)
        kept = [b[j] for j in found]
        assert sum(m.size for m in SequenceMatcher(None, a, kept, autojunk=False).get_matching_blocks()) <= len(kept)
        it = iter(a)
        assert all(x in it for x in kept)  # in a's order


def test_patience_keeps_order():
    a, b = [1, 2, 3, 4, 5], [9, 2, 3, 8, 5, 2]
    assert alignment.aligned(a, b) == [1, 2, 4]
    assert alignment.aligned([], [1]) == []


def test_empty_table_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, kept int")
    assert alignment.without_common_blocks(empty).count() == 0
    rows = [(1, "a\nb", 5, 6), (2, "x\na\nb", 7, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid int, place int")
    assert sorted((r.doc_id, r.n_removed, r.kept) for r in alignment.without_common_blocks(df).collect()) == [(1, 0, "a\nb"), (2, 2, "x")]
