"""SimHash near-duplicates by a byte-position inverted index.

A fingerprint has 8 bytes; two fingerprints that differ in at most 3 bits share
at least 5 bytes at equal positions.  The index lists fingerprints by the values
of 4 positions at a time, for the 14 sets of 4 positions that form a Steiner
system: each set of 5 shared positions contains exactly one of them, so every
such pair meets in some list, and a list is keyed by 32 bits rather than 8.
In a list, shared positional bytes are tallied for the pairs that meet, pairs
under 5 are dropped, and the rest is verified by counting differing bits.

Equal fingerprints are one entry.  A list yields a spanning forest of its links,
never all pairs: a fingerprint that is linked already only looks for those that
are not.  A list over ``BLOCK`` entries is first linked by blocks, which leaves a
large group as one component; that component is then dealt out once, and only the
other entries meet all of its blocks, and each other by pairs of blocks.  No task
holds more than two blocks of a list.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .scratch import written

MAX_BITS = 3
MIN_SHARED = 8 - MAX_BITS
BLOCK = 2048
MAX_BROADCAST = 100_000  # long lists, of a few numbers each; more are joined by an exchange
SEED = 42
#: The quadruples of 0..7 whose numbers xor to 0: any 3 positions lie in just one.
POSITIONS = tuple(q for q in combinations(range(8), 4) if q[0] ^ q[1] ^ q[2] ^ q[3] == 0)


def fingerprint(text: str | None, width: int) -> int:
    """The 64-bit SimHash of the text's shingles of ``width`` words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and whitespace alone
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < width:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = list(map(len, words))
    ends = list(accumulate(lengths, lambda a, b: a + 1 + b))
    starts = [0, *[e + 1 for e in ends[: n - width]]]
    parts = map(joined.__getitem__, map(slice, starts, ends[width - 1 :]))
    h = np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), "<u8", n - width + 1)
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        bits = np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(ones * 2 > len(h), bitorder="little").tobytes(), "little")


def with_fingerprint(df: DataFrame, text: str, width: int, into: str) -> DataFrame:
    """``df`` with the fingerprint as a signed long; a null or empty text has 0.  A column already named ``into`` is replaced."""
    df = df.drop(*[c for c in df.columns if c.lower() == into.lower()])
    out = T.StructType([*df.schema.fields, T.StructField(into, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            made = np.fromiter((fingerprint(t.as_py(), width) for t in texts), np.uint64, len(texts)).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made)], schema=batch.schema.append(pa.field(into, pa.int64())))

    return df.mapInArrow(run, out)


def linked(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs share MIN_SHARED positional bytes and differ in MAX_BITS bits at most."""
    x = np.ascontiguousarray(a ^ b)
    shared = (x.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    out = shared >= MIN_SHARED
    out[out] = np.bitwise_count(x[out]) <= MAX_BITS
    return out


def forest(fps: np.ndarray) -> list[tuple[int, int]]:
    """Links that connect what is connected among these fingerprints, at most one fewer than there are."""
    out, rest = [], fps
    while len(rest) > 1:
        front, rest = [rest[0]], rest[1:]
        while front and len(rest):
            at = front.pop()
            hit = linked(np.broadcast_to(at, rest.shape), rest)
            if hit.any():
                out += [(at, x) for x in rest[hit]]
                front += list(rest[hit])
                rest = rest[~hit]
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from rows (list, i, j, fp) that come in order of (list, i, j)."""
    held = None
    for batch in _then_none(batches):
        if batch is not None:
            now = np.column_stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(4)])
            held = now if held is None else np.concatenate([held, now])
        if held is None or not len(held):
            continue
        cuts = np.flatnonzero((held[1:, :3] != held[:-1, :3]).any(axis=1)) + 1
        bounds = np.concatenate([[0], cuts, [len(held)] if batch is None else []]).astype(np.int64)
        sizes = np.diff(bounds)
        fp = np.ascontiguousarray(held[:, 3]).view(np.uint64)
        twos = bounds[:-1][sizes == 2]
        a, b = fp[twos], fp[twos + 1]
        hit = linked(a, b) if len(twos) else np.zeros(0, bool)
        links = list(zip(a[hit], b[hit], strict=True))
        for s, n in zip(bounds[:-1][sizes > 2], sizes[sizes > 2], strict=True):
            links += forest(fp[s : s + n])
        held = held[bounds[-1] :] if len(bounds) else held
        both = np.array(links, np.uint64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ascontiguousarray(both[:, k]).view(np.int64)) for k in range(2)], names=["a", "b"]
        )


def _then_none(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def links(fps: DataFrame) -> DataFrame:
    """(a, b): links that connect all fingerprints of column ``fp`` (distinct longs) which differ in MAX_BITS bits or fewer."""
    byte = lambda p: F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255))
    keys = []
    for k, q in enumerate(POSITIONS):
        key = F.lit(k << 32)
        for n, p in enumerate(q):
            key = key.bitwiseOR(F.shiftleft(byte(p), 8 * n))
        keys.append(key)
    entries = fps.select("fp", F.explode(F.array(*keys)).alias("list"))
    hot = written(entries.groupBy("list").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK), "hot")
    n_hot = hot.count()
    met = lambda cells: cells.select("list", "i", "j", "fp").repartition("list", "i", "j").sortWithinPartitions("list", "i", "j").mapInArrow(_runs, "a long, b long")
    if not n_hot:
        return met(entries.select("list", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp"))
    few = lambda df: F.broadcast(df) if n_hot <= MAX_BROADCAST else df.hint("merge")
    block = lambda of: F.pmod(F.xxhash64("fp", "list"), F.ceil(F.col(of) / BLOCK)).cast("int")
    each = lambda of: F.sequence(F.lit(0), F.ceil(F.col(of) / BLOCK).cast("int") - 1)
    cold = entries.join(few(hot), "list", "left_anti").select("list", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp")
    in_hot = entries.join(few(hot), "list")
    found = written(met(in_hot.select("list", block("size").alias("i"), F.lit(0).alias("j"), "fp")), "found")
    roots = components(found).withColumnRenamed("node", "fp")
    rooted = written(in_hot.drop("size").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "rooted")
    counts = rooted.groupBy("list", "root").agg(F.count("*").alias("n"))
    main = counts.groupBy("list").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"))
    main = written(main.select("list", F.col("top.root").alias("main"), F.col("top.n").alias("mains"), (F.col("all") - F.col("top.n")).alias("others")), "main")
    rooted = rooted.join(few(main), "list").where("others > 0")
    is_main = F.col("root") == F.col("main")
    once = rooted.where(is_main).select("list", block("mains").alias("i"), F.explode(each("others")).alias("j"), "fp")
    rest = rooted.where(~is_main).withColumn("own", block("others"))
    with_main = rest.select("list", F.explode(each("mains")).alias("i"), F.col("own").alias("j"), "fp")
    apart = rest.withColumn("other", F.explode(each("others"))).select("list", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp")
    cells = once.unionByName(with_main).withColumn("i", -F.col("i") - 1).unionByName(apart)
    return met(cold.unionByName(cells)).unionByName(found)


def near_duplicates(df: DataFrame, fp: str, doc_id: str) -> DataFrame:
    """(fp, component_id): for each distinct fingerprint the smallest doc_id that its links reach.

    Null ids are passed over; a component of null ids alone has a null id.
    """
    fps = written(df.groupBy(F.col(fp).alias("fp")).agg(F.min(doc_id).alias("least")), "fps")
    roots = components(links(fps.select("fp")))
    labelled = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    labelled = written(labelled, "labelled")
    ids = labelled.groupBy("root").agg(F.min("least").alias("component_id"))
    return labelled.join(ids, "root").select("fp", "component_id")


WIDTH = 3


def op3_simhash_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint of 3-word shingles and its component."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    slim = written(with_fingerprint(docs, "text", WIDTH, "fp").drop("text"), "fingerprints")
    ids = near_duplicates(slim, "fp", "doc_id")
    return slim.join(ids, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


QUERIES = {"op3_simhash_bytes": op3_simhash_bytes}
