"""Line dedup by pairwise alignment.

Documents that share a line are paired through the line's hash, each pair is
aligned with a patience diff, and the blocks that both have are deleted from the
later document.  What is left is what aligning all pairs would leave, however
many documents hold a line, without making all pairs:

1. Each holder of a line is paired with the line's first holder.
2. A line of a document that still stands somewhere in it is *open* while earlier
   holders are untried.  Round by round, open lines are paired with the next
   holders, eight times as many as before, until none is open.

A line that has gone needs no further partner, as a pair can only delete lines
that it shares; so the rarest lines are settled at once and a line that a third
of the documents hold costs each of them one pair, unless patience can't place it.

Exact copies are one document for pairing and lose all their lines to the first
of them.  Lines are told apart by 64 bits for pairing and by 96 for alignment,
whole texts by 128.  Lines and their counts are dealt by salt, a document that is
the earlier one of many pairs is repeated once for ``PARTNERS`` of them, and a
later one meets its partners in a stream, one at a time.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import written

SALTS = 8
PARTNERS = 256  # pairs that one copy of an earlier document serves
HOLDERS = 256  # of a line that share a key where holders are ranked and tried
GROWTH = 8  # of the number of holders tried, from round to round
BLANK = 0  # the hash of a line without a word


def _unique_matches(a: list[int], b: list[int], alo: int, ahi: int, blo: int, bhi: int) -> list[tuple[int, int]]:
    """Lines found once in both stretches, as the longest run of pairs that rises on both sides."""
    count_a, count_b = Counter(a[alo:ahi]), Counter(b[blo:bhi])
    where = {a[i]: i for i in range(alo, ahi) if count_a[a[i]] == 1}
    pairs = [(where[b[j]], j) for j in range(blo, bhi) if b[j] in where and count_b[b[j]] == 1]
    tails: list[int] = []
    tops: list[int] = []
    prior = [-1] * len(pairs)
    for k, (i, _) in enumerate(pairs):
        at = bisect_left(tails, i)
        prior[k] = tops[at - 1] if at else -1
        if at == len(tails):
            tails.append(i)
            tops.append(k)
        else:
            tails[at], tops[at] = i, k
    out, k = [], tops[-1] if tops else -1
    while k >= 0:
        out.append(pairs[k])
        k = prior[k]
    return out[::-1]


def aligned(a: list[int], b: list[int]) -> list[int]:
    """The lines of ``b`` that a patience diff aligns with equal lines of ``a``.

    Equal lines at both ends of a stretch are aligned, then those found once on both sides; the stretches between
    them likewise.  A stretch without such lines is different throughout.
    """
    found: list[int] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        while alo < ahi and blo < bhi and a[alo] == b[blo]:
            found.append(blo)
            alo, blo = alo + 1, blo + 1
        while alo < ahi and blo < bhi and a[ahi - 1] == b[bhi - 1]:
            found.append(bhi - 1)
            ahi, bhi = ahi - 1, bhi - 1
        anchors = _unique_matches(a, b, alo, ahi, blo, bhi) if alo < ahi and blo < bhi else []
        for i, j in anchors:
            found.append(j)
            todo.append((alo, i, blo, j))
            alo, blo = i + 1, j + 1
        if anchors:
            todo.append((alo, ahi, blo, bhi))
    return sorted(found)


def _told_apart(lines: pa.Scalar, checks: pa.Scalar) -> tuple[list[int], list[int]]:
    """(96 bits of each line with a word, its place)."""
    both = zip(lines.as_py(), checks.as_py(), strict=True)
    kept = [((x << 32) | (y & 0xFFFFFFFF), k) for k, (x, y) in enumerate(both) if x != BLANK]
    return [x for x, _ in kept], [k for _, k in kept]


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rid, gone, done) from rows (later, earlier, lines, checks) in order: a later document (earlier null), then its partners.

    ``gone`` are the places of its lines that some partner aligns; of the lines ``done`` none is left.
    """
    later, lines, places, gone = None, [], [], set()

    def result() -> list[tuple]:
        if not gone:
            return []
        left = {lines[j] for j in range(len(lines)) if j not in gone}
        done = sorted({lines[j] >> 32 for j in gone if lines[j] not in left})
        return [(later, sorted(places[j] for j in gone), done)]

    for batch in _then_none(batches):
        rows = []
        if batch is None:
            rows = result()
        else:
            for rid, earlier, x, checks in zip(*batch.columns, strict=True):
                if not earlier.is_valid:
                    rows += result()
                    later, gone = rid.as_py(), set()
                    lines, places = _told_apart(x, checks)
                elif len(gone) < len(lines):
                    gone.update(aligned(_told_apart(x, checks)[0], lines))
        types = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["rid", "gone", "done"])


def _then_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def _gone(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(rid, gone, done) for the later documents of ``pairs`` (earlier, later, n) that lose lines; n bounds an earlier one's pairs by a line."""
    parts = F.ceil(F.col("n") / PARTNERS).cast("int")
    pairs = pairs.groupBy("earlier", "later").agg(F.max(parts).alias("parts"))
    pairs = pairs.select("earlier", "later", "parts", F.pmod(F.xxhash64("later"), F.col("parts")).cast("int").alias("part"))
    pairs = written(pairs, "pairs")
    needed = pairs.groupBy("earlier").agg(F.max("parts").alias("parts"))
    body = docs.select("rid", "lines", "checks")
    sources = body.join(needed, body["rid"] == needed["earlier"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    partners = pairs.drop("parts").join(sources.select("earlier", "part", "lines", "checks").hint("merge"), ["earlier", "part"])
    partners = partners.select("later", "earlier", "lines", "checks")
    own = body.join(pairs.select(F.col("later").alias("rid")).distinct(), "rid", "left_semi")
    own = own.select(F.col("rid").alias("later"), F.lit(None).cast("long").alias("earlier"), "lines", "checks")
    rows = own.unionByName(partners).repartition("later").sortWithinPartitions("later", F.col("earlier").asc_nulls_first())
    return rows.mapInArrow(_align, "rid long, gone array<int>, done array<long>")


def _parts() -> Column:
    """Into how many parts the holders of a line are dealt, from their number ``n``."""
    return F.ceil(F.col("n") / HOLDERS).cast("int")


def _part() -> Column:
    return F.pmod(F.xxhash64("rid"), _parts()).cast("int")


def gone_lines(docs: DataFrame) -> DataFrame:
    """(rid, gone): places of lines that earlier documents take, from rows (rid, place, lines, checks); ``place`` orders the documents.

    A document has a row a round that it loses lines in.
    """
    lines = docs.select("rid", "place", F.explode(F.array_distinct("lines")).alias("line")).where(F.col("line") != BLANK)
    lines = written(lines, "lines")
    holders = lines.groupBy("line").agg(F.count("*").alias("n"), F.min(F.struct("place", "rid")).alias("first")).where("n > 1")
    # a hot line is dealt by salt: its one row of ``holders`` can be repeated
    salt = F.pmod("rid", F.lit(SALTS)).cast("int")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    held = lines.withColumn("salt", salt).join(holders.withColumn("salt", salts).hint("merge"), ["line", "salt"]).drop("salt")
    held = written(held.select("line", "rid", "place", "n", F.col("first.rid").alias("first")), "held")
    out = [written(_gone(held.where("first != rid").select(F.col("first").alias("earlier"), F.col("rid").alias("later"), "n"), docs), "gone")]
    tried, open_ = 1, held.where("n > 2 and first != rid").select("line", "rid", "place", "n")
    while True:
        done = out[-1].select("rid", F.explode("done").alias("line"))
        open_ = open_.where(F.col("n") > tried + 1).join(done, ["rid", "line"], "left_anti")
        # a line's holders are dealt by parts of HOLDERS, and ranked by part before they are ranked together
        upto = tried * GROWTH
        wanted = open_.select("line", "n").distinct().select("line", F.explode(F.sequence(F.lit(0), _parts() - 1)).alias("part"))
        next_ = held.where(F.col("n") > tried).withColumn("part", _part()).join(wanted, ["line", "part"], "left_semi")
        for by in (["line", "part"], ["line"]):
            next_ = next_.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("place"))).where(F.col("rank") <= upto)
        next_ = next_.where(F.col("rank") > tried).select("line", F.col("rid").alias("earlier"), F.col("place").alias("before"), "n")
        next_ = next_.withColumn("part", F.explode(F.sequence(F.lit(0), _parts() - 1))).drop("n")
        pairs = open_.withColumn("part", _part()).join(next_, ["line", "part"]).where(F.col("before") < F.col("place"))
        pairs = written(pairs.select("earlier", F.col("rid").alias("later"), "line", "place", "n"), "tries")
        if pairs.isEmpty():
            break
        open_ = pairs.select("line", F.col("later").alias("rid"), "place", "n").distinct()
        out.append(written(_gone(pairs.select("earlier", "later", "n"), docs), "gone"))
        tried = upto
    return reduce(DataFrame.unionByName, [o.select("rid", "gone") for o in out])


OUT = "doc_id long, n_lines long, n_removed long, n_blocks long, kept string"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, text, copy, gone in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            parts = (text or "").split("\n")
            said = np.array([bool(p.strip(" \t\n\x0b\x0c\r")) for p in parts])
            out = np.zeros(len(parts) + 1, bool)
            if copy and said.any():
                out[:-1] = True
            elif gone:
                for g in gone:
                    out[g] = True
                # a line without a word goes if the lines with words before and after it go, as far as there are any
                at = np.flatnonzero(said)
                fate = np.concatenate([[True], out[at], [True]])
                before = np.cumsum(said)
                out[:-1] = np.where(said, out[:-1], fate[before] & fate[before + 1])
            starts = out.copy()
            starts[1:] &= ~out[:-1]
            kept = "\n".join(p for p, x in zip(parts, out[:-1], strict=True) if not x)
            rows.append((doc, len(parts), int(out.sum()), int(starts.sum()), kept))
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)] + [pa.array([r[4] for r in rows], pa.string())],
            names=["doc_id", "n_lines", "n_removed", "n_blocks", "kept"],
        )


def without_common_blocks(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_lines, n_removed, n_blocks, kept) for each row: what is left of its text, and counts of lines.

    Lines are what stands between line feeds; a null text is an empty one.  Lines without a word align with nothing:
    they go if the nearest lines with words on both sides go.  The earlier document is that with the smaller id; null
    ids come last, and equal ids go by their place in the input.  Repeated rows are copies: the first stays, the
    others lose all.  Other columns aren't read, whatever their names.  No rows give an empty result.
    """
    clean = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = written(
        df.select(F.col(doc_id).alias("doc_id"), clean.alias("text")).withColumn("rid", F.monotonically_increasing_id()), "texts"
    )
    blank = r"^[\x20\x09-\x0D]*$"
    line = lambda x: F.when(x.rlike(blank), F.lit(BLANK).cast("long")).otherwise(F.xxhash64(x))
    slim = rows.select(
        "rid", F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "rid").alias("place"), F.unhex(F.md5("text")).alias("whole"),
        F.transform(F.split("text", "\n", -1), line).alias("lines"), F.transform(F.split("text", "\n", -1), lambda x: F.hash(x)).alias("checks"),
    )
    slim = written(slim, "hashes")
    firsts = slim.groupBy("whole").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    copied = firsts.where("n > 1").select("whole", F.col("first.rid").alias("first"))
    salted = copied.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = slim.withColumn("salt", F.pmod("rid", F.lit(SALTS)).cast("int"))  # so are the copies of one text
    marked = written(dealt.join(salted.hint("merge"), ["whole", "salt"], "left").withColumn("copy", F.coalesce(F.col("first") != F.col("rid"), F.lit(False))), "marked")
    gone = gone_lines(marked.where(~F.col("copy")).select("rid", "place", "lines", "checks"))
    gone = gone.groupBy("rid").agg(F.collect_list("gone").alias("gone"))  # a few rounds' rows
    fate = marked.select("rid", "copy").join(gone, "rid", "left").where(F.col("copy") | F.col("gone").isNotNull())
    cut = rows.join(written(fate, "fate").hint("merge"), "rid", "left")  # the same plan at every size
    return cut.select(F.col("doc_id").cast("long"), "text", "copy", "gone").mapInArrow(_cut, OUT)


def op10_patience_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the digest of what is left of each document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_common_blocks(docs).select("doc_id", "n_lines", "n_removed", "n_blocks", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op10_patience_lines": op10_patience_lines}
