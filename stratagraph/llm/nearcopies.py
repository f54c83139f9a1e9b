"""Near copies by a similarity of shingle sets, from long SimHash fingerprints.

A fingerprint of ``BITS`` bits over a text's distinct shingles tells the cosine
of two shingle sets by the share of bits that differ, and with the sets' sizes
their Jaccard similarity, with a standard error of about 0.025 at 0.8.

Candidates come from a byte-position inverted index: entries are listed by the
values at a pair of positions, ``PAIRS`` pairs that have no position in common.
Texts of similarity 0.8 share about a quarter of the bytes, so they meet in some
list all but surely (0.99 at 0.8, 0.999 at 0.85: pairs with common positions would
miss five times as many), unrelated ones in few.  In a list, shared positional
bytes of the first ``INDEX_BYTES`` are tallied, pairs under ``MIN_SHARED`` are
dropped, and differing bits counted; entries that have a partner left are looked
at again with their whole fingerprints.  Links that are
surely similar stand; those near the limit are checked by the texts' shingles.

A list first yields the greatest spanning forest of its estimates, never all pairs:
whatever limit is put on the estimate, they connect what all pairs would connect.
As the check by shingles may drop a link of the forest whose displaced neighbour
would hold, the lists are then read again: texts with a partner near the limit that
the checked links leave apart carry their shingles to their lists and are compared
there, so that only links are put out and never pairs.
In lists over ``BLOCK`` entries a large group of near copies is linked by blocks
first and then dealt out once, so it costs its size and never its square.  A list's
length grows with the corpus over 65536; three positions a list suit more than some
hundred million texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .columns import free
from .components import components
from .scratch import written

BITS = 1024
INDEX_BYTES = 32
PAIRS = tuple((i, i + 1) for i in range(0, BITS // 8, 2))
MIN_SHARED = 3  # of the first INDEX_BYTES
LOOSE = 58  # differing bits of the indexed 256; at similarity 0.8 they are 39, standard deviation 5.7
SIMILAR = 0.8
MARGIN = 0.07  # of the estimate, nearly three standard errors; links within it are checked
BLOCK = 2048
SEEDS = 8  # position pairs whose long lists are linked by blocks first
MAX_BROADCAST = 100_000  # hot lists, of twelve bytes each; more are joined by an exchange
SEED = 42
_WORDS = BITS // 64
_STEPS = (np.arange(1, _WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]


def shingles(text: str | None, width: int) -> np.ndarray:
    """Hashes of the distinct shingles of ``width`` words, in ASCII lower case; fewer words are one shingle, none give none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-1] + 1)
    n = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1 :]
    made = [xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)]
    return np.unique(np.array(made, np.uint64))


def fingerprint(found: np.ndarray) -> bytes:
    """BITS bits, each set if it is in over half of the shingles' hashes; the words of a hash follow from it by mixing."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(found), 2048):
        x = found[None, i : i + 2048] + _STEPS
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        bits = np.unpackbits(np.ascontiguousarray(x.T).view(np.uint8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return np.packbits(ones * 2 > len(found), bitorder="little").tobytes()


def with_fingerprint(df: DataFrame, text: str, width: int, into: str, count: str) -> DataFrame:
    """``df`` with the fingerprint (binary) and the number of distinct shingles of each whole text; null as empty."""
    out = T.StructType([*df.schema.fields, T.StructField(into, T.BinaryType()), T.StructField(count, T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py(), width) for t in batch.column(batch.schema.get_field_index(text))]
            made = [pa.array(map(fingerprint, found), pa.binary()), pa.array(map(len, found), pa.int32())]
            schema = batch.schema.append(pa.field(into, pa.binary())).append(pa.field(count, pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], schema=schema)

    return df.mapInArrow(run, out)


def loosely(a: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Which of ``rest`` share MIN_SHARED positional bytes with ``a`` and differ in LOOSE bits at most."""
    x = np.ascontiguousarray(rest ^ a)
    out = (x.view(np.uint8).reshape(len(rest), -1) == 0).sum(axis=1) >= MIN_SHARED
    out[out] = np.bitwise_count(x[out]).sum(axis=1) <= LOOSE
    return out


def similarity(a: np.ndarray, n: int, rest: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The estimated Jaccard similarity of a text with others, from fingerprints and numbers of shingles."""
    share = np.bitwise_count(rest ^ a).sum(axis=1) / BITS
    both = np.cos(np.pi * share) * np.sqrt(n * sizes)
    return both / np.maximum(n + sizes - both, 1e-9)


def tied(n: int, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """A spanning forest, as pairs of numbers below ``n``; ``near(k, rest)`` tells which of ``rest`` are near k."""
    out, rest = [], np.arange(n)
    while len(rest) > 1:
        front, rest = [int(rest[0])], rest[1:]
        while front and len(rest):
            at = front.pop()
            hit = near(at, rest)
            if hit.any():
                out += [(at, int(x)) for x in rest[hit]]
                front += rest[hit].tolist()
                rest = rest[~hit]
    return out


def spanning(n: int, alike: Callable[[int, np.ndarray], np.ndarray], least: float) -> list[tuple[int, int, float]]:
    """The greatest spanning forest over numbers below ``n``, without links under ``least``; ``alike(k, rest)`` are similarities."""
    out, rest = [], np.arange(1, n)
    best, parent = alike(0, rest), np.zeros(len(rest), np.int64)
    while len(rest):
        k = int(best.argmax())
        at = int(rest[k])
        if best[k] >= least:
            out.append((int(parent[k]), at, float(best[k])))
        keep = np.arange(len(rest)) != k
        rest, best, parent = rest[keep], best[keep], parent[keep]
        now = alike(at, rest)
        nearer = now > best
        best[nearer], parent[nearer] = now[nearer], at
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """(rows, firsts, sizes) of the runs of two rows and more with equal (list, i, j), from rows in that order; each run whole."""
    held = None

    def cut(table: pa.Table, last: bool) -> tuple[np.ndarray, int]:
        key = np.column_stack([table[k].to_numpy() for k in ("list", "i", "j")])
        at = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
        bounds = np.concatenate([[0], at, [len(key)] if last else []]).astype(np.int64)
        return bounds, int(bounds[-1])

    def runs(table: pa.Table, bounds: np.ndarray) -> tuple[pa.Table, np.ndarray, np.ndarray]:
        sizes = np.diff(bounds)
        return table, bounds[:-1][sizes > 1], sizes[sizes > 1]

    for batch in batches:
        now = pa.Table.from_batches([batch])
        held = now if held is None else pa.concat_tables([held, now]).combine_chunks()
        if held.num_rows:
            bounds, upto = cut(held, False)
            yield runs(held, bounds)
            held = held.slice(upto)
    if held is not None and held.num_rows:
        held = held.combine_chunks()
        yield runs(held, cut(held, True)[0])


def _words(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64).reshape(-1, size // 8)


def _partnered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries (list, i, j, node) that have a partner with another root by the index's bytes."""
    for table, firsts, sizes in _runs(batches):
        keep = np.zeros(table.num_rows, bool)
        if len(firsts):
            head, root = _words(table["head"], INDEX_BYTES), table["root"].to_numpy()
            two = firsts[sizes == 2]
            hit = two[loosely(head[two], head[two + 1]) & (root[two] != root[two + 1])] if len(two) else two
            keep[hit] = keep[hit + 1] = True
            for s, n in zip(firsts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                for a, b in tied(n, lambda k, rest, s=s: loosely(head[s + k], head[s + rest]) & (root[s + rest] != root[s + k])):
                    keep[s + a] = keep[s + b] = True
        rows = table.select(["list", "i", "j", "node"]).filter(pa.array(keep))
        yield from rows.combine_chunks().to_batches() or [pa.RecordBatch.from_pylist([], schema=rows.schema)]


def _sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that connect what is surely similar in each block of entries (list, i, j, node, fp, n)."""
    for table, firsts, sizes in _runs(batches):
        links: list[tuple[int, int]] = []
        if len(firsts):
            fp, count, node = _words(table["fp"], BITS // 8), table["n"].to_numpy().astype(float), table["node"].to_numpy()
            for s, n in zip(firsts.tolist(), sizes.tolist(), strict=True):
                near = lambda k, rest, s=s: similarity(fp[s + k], count[s + k], fp[s + rest], count[s + rest]) >= SIMILAR + MARGIN
                links += [(int(node[s + a]), int(node[s + b])) for a, b in tied(n, near)]
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b, alike) of each list's forest of entries (list, i, j, node, fp, n)."""
    for table, firsts, sizes in _runs(batches):
        links: list[tuple[int, int, float]] = []
        if len(firsts):
            fp, count, node = _words(table["fp"], BITS // 8), table["n"].to_numpy().astype(float), table["node"].to_numpy()
            for s, n in zip(firsts.tolist(), sizes.tolist(), strict=True):
                alike = lambda k, rest, s=s: similarity(fp[s + k], count[s + k], fp[s + rest], count[s + rest])
                links += [(int(node[s + a]), int(node[s + b]), x) for a, b, x in spanning(n, alike, SIMILAR - MARGIN)]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], t) for k, t in enumerate(kinds)], names=["a", "b", "alike"])


def _met_first(fp: np.ndarray, k: int, rest: np.ndarray, at: int) -> np.ndarray:
    """Which of ``rest`` meet entry ``k`` in no list before those of position pair ``at``: a pair counts in one list alone."""
    same = fp[rest].view(np.uint8).reshape(len(rest), -1) == fp[k].view(np.uint8)
    return ~np.any([same[:, p] & same[:, q] for p, q in PAIRS[:at]], axis=0) if at else np.ones(len(rest), bool)


def _near_limit(fp: np.ndarray, count: np.ndarray, root: np.ndarray, k: int, end: int, at: int) -> np.ndarray:
    """The entries after ``k`` with another root that may be similar to it and that it meets here first."""
    rest = np.flatnonzero(root[k + 1 : end] != root[k]) + k + 1
    if len(rest):
        rest = rest[similarity(fp[k], count[k], fp[rest], count[rest]) >= SIMILAR - MARGIN]
    return rest[_met_first(fp, k, rest, at)] if len(rest) else rest


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries (list, i, j, node, fp, n, root) that have a partner near the limit with another root."""
    for table, firsts, sizes in _runs(batches):
        keep = np.zeros(table.num_rows, bool)
        if len(firsts):
            fp, count = _words(table["fp"], BITS // 8), table["n"].to_numpy().astype(float)
            list_, root = table["list"].to_numpy(), table["root"].to_numpy()
            for s, n in zip(firsts.tolist(), sizes.tolist(), strict=True):
                for k in range(s, s + n - 1):
                    near = _near_limit(fp, count, root, k, s + n, int(list_[s]) >> 16)
                    keep[near] = True
                    keep[k] |= len(near) > 0
        rows = table.filter(pa.array(keep))
        yield from rows.combine_chunks().to_batches() or [pa.RecordBatch.from_pylist([], schema=rows.schema)]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that hold by the shingles, at most one fewer than entries (list, i, j, node, fp, n, root, said): what is linked isn't tried again."""
    for table, firsts, sizes in _runs(batches):
        links: list[tuple[int, int]] = []
        if len(firsts):
            fp, count = _words(table["fp"], BITS // 8), table["n"].to_numpy().astype(float)
            list_, node, root = (table[c].to_numpy() for c in ("list", "node", "root"))
            root, said = root.copy(), [np.frombuffer(x, np.uint64) for x in table["said"].to_pylist()]
            for s, n in zip(firsts.tolist(), sizes.tolist(), strict=True):
                for k in range(s, s + n - 1):
                    for x in _near_limit(fp, count, root, k, s + n, int(list_[s]) >> 16).tolist():
                        if root[x] != root[k] and jaccard(said[k], said[x]):
                            links.append((int(node[k]), int(node[x])))
                            here = root[s : s + n]
                            here[here == root[x]] = root[k]
        yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in links], pa.int64()) for c in (0, 1)], names=["a", "b"])


def jaccard(x: np.ndarray, y: np.ndarray) -> bool:
    """Whether two sets of shingles are similar."""
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= SIMILAR * (len(x) + len(y) - both)


ORDER = ("list", "i", "j")


def entries(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of ``nodes`` (node long, fp binary, n int; fingerprints are distinct) the entries (list, i, j, node, fp, n) with a partner, and (a, b), links found on the way.

    A list over BLOCK entries is first cut into blocks, as many in each of a few lists as it takes, in which what is
    surely similar is linked.  That leaves a large group of near copies as one component.  A list's largest component
    is then dealt out once, and only the other entries meet all of its blocks, and each other by pairs of blocks.
    """
    value = lambda p, n=1: F.conv(F.hex(F.substring("fp", p + 1, n)), 16, 10).cast("long")
    both = lambda p, q: value(p, 2) if q == p + 1 else value(p) * 256 + value(q)
    keys = F.array(*[F.lit(k << 16) + both(p, q) for k, (p, q) in enumerate(PAIRS)])
    listed = nodes.select("node", F.substring("fp", 1, INDEX_BYTES).alias("head"), F.explode(keys).alias("list"))
    sizes = nodes.select(F.explode(keys).alias("list")).groupBy("list").agg(F.count("*").alias("size"))
    hot = written(sizes.where(F.col("size") > BLOCK), "hot")
    n_hot = hot.count()
    cold = lambda df: df.select("list", F.lit(0).alias("i"), F.lit(0).alias("j"), "node", "head", F.col("node").alias("root"))
    found = nodes.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)
    if n_hot:
        few = F.broadcast(hot) if n_hot <= MAX_BROADCAST else hot.hint("merge")
        block = lambda of, n: F.pmod(F.xxhash64("node", "list"), F.ceil(F.col(of) / n)).cast("int")
        in_hot = listed.join(few, "list")
        own = in_hot.where(F.col("list") < SEEDS << 16).select("list", block("size", BLOCK).alias("i"), F.lit(0).alias("j"), "node")
        own = own.join(nodes.hint("merge"), "node").select(*ORDER, "node", "fp", "n")
        found = written(own.repartition(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(_sure, "a long, b long"), "found")
        rooted = in_hot.drop("size").join(components(found), "node", "left").withColumn("root", F.coalesce("root", "node"))
        rooted = written(rooted, "rooted")
        counts = rooted.groupBy("list", "root").agg(F.count("*").alias("n"))
        main = counts.groupBy("list").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"))
        main = written(main.select("list", F.col("top.root").alias("main"), F.col("top.n").alias("mains"), (F.col("all") - F.col("top.n")).alias("others")), "main")
        rooted = rooted.join(F.broadcast(main) if n_hot <= MAX_BROADCAST else main.hint("merge"), "list")
        is_main, each = F.col("root") == F.col("main"), lambda of: F.sequence(F.lit(0), F.ceil(F.col(of) / BLOCK).cast("int") - 1)
        base = rooted.where("others > 0")
        m = base.where(is_main).select("list", block("mains", BLOCK).alias("i"), F.explode(each("others")).alias("o"), "node", "head", "root")
        o = base.where(~is_main).withColumn("own", block("others", BLOCK))
        with_main = o.select("list", F.explode(each("mains")).alias("i"), F.col("own").alias("o"), "node", "head", "root")
        cells = m.unionByName(with_main).select("list", (-F.col("i") - 1).alias("i"), F.col("o").alias("j"), "node", "head", "root")
        apart = o.withColumn("other", F.explode(each("others"))).select("list", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "head", "root")
        dealt = cold(listed.join(few, "list", "left_anti")).unionByName(cells).unionByName(apart)
    else:
        dealt = cold(listed)
    partnered = dealt.repartition(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(_partnered, "list long, i int, j int, node long")
    return partnered.join(nodes.hint("merge"), "node").select(*ORDER, "node", "fp", "n"), found


def links(listed: DataFrame) -> DataFrame:
    """(a, b, alike): links that connect the likely similar nodes of the ``entries``, by estimates."""
    return listed.repartition(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(_linked, "a long, b long, alike double")


def open_links(listed: DataFrame, known: DataFrame, sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(a, b): links that hold between ``entries`` which ``known`` (node, root) leaves in different components.

    Only entries with a partner near the limit carry their shingles, which ``sets`` gives for nodes (node), to their
    lists, and are compared there: pairs are never put out, only links, fewer than entries.
    """
    columns = [*ORDER, "node", "fp", "n", "root"]
    rows = listed.join(known, "node", "left").withColumn("root", F.coalesce("root", "node")).select(*columns)
    kinds = "list long, i int, j int, node long, fp binary, n int, root long"
    few = written(rows.repartition(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(_open, kinds), "open")
    full = few.join(sets(few.select("node").distinct()), "node").select(*columns, "said")
    return full.repartition(*ORDER).sortWithinPartitions(*ORDER).mapInArrow(_verified, "a long, b long")


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links (a, b) whose sets of shingles (x, y) are similar."""
    for batch in batches:
        keep = [jaccard(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def said_by(nodes: DataFrame, rows: DataFrame, text: str, rid: str, width: int) -> DataFrame:
    """(node, said): the shingles of the texts of ``nodes`` (node)."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array((shingles(t.as_py(), width).tobytes() for t in batch.column(1)), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), made], names=["node", "said"])

    wanted = nodes.withColumnRenamed("node", rid)
    return written(rows.join(wanted, rid, "left_semi").select(rid, text).mapInArrow(sets, "node long, said binary"), "sets")


def checked(near: DataFrame, sets: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The links (a, b) of ``near`` that hold by the texts themselves."""
    found = sets(near.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    x = found.select(F.col("node").alias("a"), F.col("said").alias("x"))
    y = found.select(F.col("node").alias("b"), F.col("said").alias("y"))
    return near.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "x", "y").mapInArrow(_shared, "a long, b long")


def similar(nodes: DataFrame, rows: DataFrame, text: str, rid: str, width: int) -> DataFrame:
    """(node, root) for the ``nodes`` that aren't their component's smallest.  Pairs that checked links make needless aren't checked."""
    listed, found = entries(nodes)
    listed = written(listed, "entries")
    near = written(links(listed).groupBy("a", "b").agg(F.max("alike").alias("alike")), "near")
    sure = near.where(F.col("alike") >= SIMILAR + MARGIN).select("a", "b").union(found)
    known = components(sure)
    ends = [known.select(F.col("node").alias(e), F.col("root").alias(f"root_{e}")) for e in ("a", "b")]
    open_ = near.where(F.col("alike") < SIMILAR + MARGIN).join(ends[0], "a", "left").join(ends[1], "b", "left")
    open_ = written(open_.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b"), "open")
    sets = lambda wanted: said_by(wanted, rows, text, rid, width)
    held = components(known.toDF("a", "b").union(written(checked(open_, sets), "held")))  # a component's star stands for its links
    return components(held.toDF("a", "b").union(open_links(listed, held, sets)))


def one_of_each(df: DataFrame, text: str = "text", doc_id: str = "doc_id", width: int = 5) -> DataFrame:
    """The rows of ``df``, one of each component of similar texts: that with the smallest id.

    Null ids come last; of equal ids and of repeated rows one stays.  Texts without words have equal fingerprints
    and form one component.  Columns stay as they are.
    """
    fp, count, rid = free(df, "__fp", "__count", "__rid")
    made = with_fingerprint(df, text, width, fp, count).withColumn(rid, F.monotonically_increasing_id())
    rows = written(made, "rows")
    place = F.struct(F.col(doc_id).isNull(), F.col(doc_id), F.col(rid).alias("rid"))
    nodes = rows.groupBy(F.col(fp).alias("fp")).agg(F.min(place).alias("first"), F.max(count).alias("n"))
    nodes = written(nodes.select(F.col("first.rid").alias("node"), "first", "fp", "n"), "nodes")
    roots = similar(nodes.select("node", "fp", "n"), rows, text, rid, width)
    root = nodes.select("node", "first").withColumnRenamed("node", "own").join(roots, F.col("own") == F.col("node"), "left")
    firsts = root.groupBy(F.coalesce("root", "own")).agg(F.min("first").alias("first"))
    stay = firsts.select(F.col("first.rid").alias(rid))
    return rows.join(stay, rid, "left_semi").drop(fp, count, rid)
