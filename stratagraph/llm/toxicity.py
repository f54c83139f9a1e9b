"""Toxicity scores from subword-bag embeddings.

A word is the mean of the vectors of its character n-grams (hashed into
``BUCKETS``), a text the mean of its words, and a linear softmax on top gives
the score.  Vectors and softmax are trained jointly in numpy by gradient descent
over small batches of a bounded sample of labelled texts.  Every n-gram of the
sample has a vector.  It enters by its spread and by a confidence that grows with
what it tells about the label, so that n-grams which hardly tell anything learn
hardly anything by heart; there is no cut.  A misspelling that was never seen
still shares n-grams with what it misspells.

Bound: at most ``MAX_CLEAN`` + ``MAX_TOXIC`` labelled ids, picked by a hash, reach
the driver, each with one text of ``MAX_BYTES`` at most (longer ones teach nothing);
class weights restore the labelled shares.  All documents are scored whole in one
pass without an exchange; what the executors get is one number a bucket, as the
softmax is linear in the vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BITS = 18
BUCKETS = 1 << BITS
DIM = 4
GRAMS = (3, 6)  # least and greatest length
MAX_TOXIC = 2500
MAX_CLEAN = 5000
MAX_BYTES = 40_000  # of a text that teaches
BATCH = 256
STEPS = 240
RATE = 0.5  # falls to 0 with the steps
DOUBT = 24.0, 0.008  # chi-square at which an n-gram is half trusted, at least, and as a share of the training texts,
TRUST = 4  # to this power
BLOCK_CHARS = 300_000
BLOCK_TEXTS = 40
THRESHOLD = 0.3


@dataclass
class Model:
    """value: of each bucket, its vector times the difference of the softmax's rows; bias likewise."""

    value: np.ndarray
    bias: float


@dataclass
class Grams:
    """Character n-grams of a block of texts; each belongs to a word, each word to a text."""

    bucket: np.ndarray  # of each gram
    word: np.ndarray  # of each gram
    per_word: np.ndarray  # grams of each word
    text: np.ndarray  # of each word
    per_text: np.ndarray  # words of each text


def _letters() -> np.ndarray:
    """For each code point of the basic plane, whether it is part of a word."""
    return np.array([chr(c).isalnum() for c in range(0x10000)])


LETTERS = _letters()
VISIBLE = np.array([not chr(c).isspace() for c in range(0x10000)])


def grams(texts: list[str | None], inner: np.ndarray = LETTERS) -> Grams:
    """The n-grams of the texts' words, in lower case, each word with a mark at both ends.

    Words are runs of ``inner`` characters, letters and digits by default; code points past the basic plane are inner.
    """
    lower = [(t or "").lower() for t in texts]
    joined = " " + " ".join(lower) + " "
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    inside = inner[np.minimum(c, 0xFFFF)] | (c > 0xFFFF)
    c = np.where(inside, c, np.uint32(1))
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    word_at = np.cumsum(starts) - 1
    first = np.flatnonzero(starts)
    ends = np.cumsum([1, *(len(t) + 1 for t in lower)])
    text = np.searchsorted(ends, first, side="right") - 1
    bucket, word = [], []
    h, fits = c * np.uint32(2654435761), np.ones(len(c), bool)
    for n in range(2, GRAMS[-1] + 1):
        h = (h[:-1] ^ (c[n - 1 :] + np.uint32(n))) * np.uint32(2246822519)
        h ^= h >> np.uint32(13)
        if n > 2:
            fits = fits[: len(h)] & inside[n - 2 : len(inside) - 1]
        else:
            fits = fits[: len(h)]
        if n >= GRAMS[0]:
            at = np.flatnonzero(fits)
            bucket.append(h[at] * np.uint32(3266489917) >> np.uint32(32 - BITS))
            word.append(word_at[at + 1])
    bucket, word = np.concatenate(bucket), np.concatenate(word)
    return Grams(bucket, word, np.bincount(word, minlength=len(first)), text, np.bincount(text, minlength=len(texts)))


def scores(texts: list[str | None], model: Model, inner: np.ndarray = LETTERS) -> np.ndarray:
    """P(label 1) for each text; texts without words score by the bias alone."""
    g = grams(texts, inner)
    word = np.bincount(g.word, model.value[g.bucket], len(g.per_word)) / np.maximum(g.per_word, 1)
    mean = np.bincount(g.text, word, len(texts)) / np.maximum(g.per_text, 1)
    return 1 / (1 + np.exp(-np.clip(mean + model.bias, -40, 40)))


def _sums(rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of rows[starts[k]:starts[k + 1]]; empty stretches give 0."""
    out = np.zeros((len(starts), rows.shape[1]), rows.dtype)
    sizes = np.diff(np.append(starts, len(rows)))
    if len(rows):
        out[sizes > 0] = np.add.reduceat(rows, starts[sizes > 0], axis=0)
    return out


def _shares(texts: list[str | None], inner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text its buckets, and its share in each."""
    for i in range(0, len(texts), BLOCK_TEXTS):
        block = texts[i : i + BLOCK_TEXTS]
        g = grams(block, inner)
        text = g.text[g.word]
        key, at = np.unique(text * BUCKETS + g.bucket, return_inverse=True)
        share = np.bincount(at, 1 / (g.per_word[g.word] * g.per_text[text]), len(key)).astype(np.float32)
        cuts = np.searchsorted(key, np.arange(1, len(block)) * BUCKETS)
        yield from zip(np.split((key % BUCKETS).astype(np.int32), cuts), np.split(share, cuts), strict=True)


def confidence(held: np.ndarray, by_toxic: np.ndarray, n: int, toxic: float) -> np.ndarray:
    """How far each bucket is trusted, 0 to 1, by the chi-square of its presence in the ``n`` texts with the label."""
    odds = by_toxic * (n - toxic) - (held - by_toxic) * toxic
    chi = n * odds**2 / np.maximum(1, toxic * (n - toxic) * held * (n - held))
    return (chi / (chi + max(DOUBT[0], DOUBT[1] * n))) ** TRUST


def train(texts: list[str | None], labels: list[int], weights: list[float], inner: np.ndarray = LETTERS, seed: int = 7) -> Model:
    """A model for P(label 1).  Without any row, or with one class, it scores by the labels' share alone."""
    y, weight = np.array(labels, np.float32), np.array(weights, np.float32)
    share = float((y * weight).sum() / weight.sum()) if len(y) else 0.0
    prior = float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), prior)
    n = len(y)
    held, by_toxic, square = np.zeros(BUCKETS), np.zeros(BUCKETS), np.zeros(BUCKETS)
    rows = list(_shares(texts, inner))
    for label, (bucket, value) in zip(labels, rows, strict=True):
        held[bucket] += 1
        by_toxic[bucket] += label
        square[bucket] += value**2
    scale = (confidence(held, by_toxic, n, float(y.sum())) / np.sqrt(square / n + 1e-12)).astype(np.float32)

    rng = np.random.default_rng(seed)
    table, out = rng.normal(0, 0.1, (BUCKETS, DIM)).astype(np.float32), rng.normal(0, 1, (DIM, 2)).astype(np.float32)
    bias = np.array([0, prior], np.float32)
    target = np.stack([1 - y, y], axis=1)
    weight = (weight / weight.mean())[:, None]
    size, order = min(BATCH, n), np.zeros(0, np.int64)
    for step in range(STEPS):
        if len(order) < size:
            order = np.append(order, rng.permutation(n))
        at, order = order[:size], order[size:]
        sizes = np.array([len(rows[k][0]) for k in at])
        gram, value = (np.concatenate([rows[k][j] for k in at]) for j in (0, 1))
        value = (value * scale[gram])[:, None]
        h = _sums(table[gram] * value, np.cumsum(sizes) - sizes)
        logits = h @ out + bias
        p = np.exp(logits - logits.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        error = (p - target[at]) * weight[at] / size
        rate = RATE * (1 - step / STEPS)
        back = np.repeat((error @ out.T).astype(np.float32), sizes, axis=0) * value
        for d in range(DIM):
            table[:, d] -= rate * np.bincount(gram, back[:, d], BUCKETS)
        out -= rate * (h.T @ error)
        bias -= rate * error.sum(axis=0)
    return Model(table @ (out[:, 1] - out[:, 0]) * scale, float(bias[1] - bias[0]))


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from training: crc32 of its id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def taught(docs: DataFrame, sample: DataFrame, label: str) -> DataFrame:
    """(doc_id, text, label) of a bounded ``sample`` (doc_id, label) of ids: one text an id, the least of several, none over MAX_BYTES."""
    rows = docs.select("doc_id", "text").where(F.coalesce(F.octet_length("text"), F.lit(0)) <= MAX_BYTES)
    rows = rows.join(F.broadcast(sample), "doc_id")  # as many ids as the sample's limit says
    return rows.groupBy("doc_id", label).agg(F.min("text").alias("text")).select("doc_id", "text", label)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from the labelled ``docs`` that aren't held out.

    A document labelled more than once is toxic if any label says so; null ids,
    null labels, and labels without a document teach nothing.
    """
    known = (
        labels.select("doc_id", F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )
    total = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    picked = [
        known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        for k, most in ((1, MAX_TOXIC), (0, MAX_CLEAN))
    ]
    sample = picked[0].union(picked[1])
    rows = taught(docs, sample, "toxic").toArrow()
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    ys = rows["toxic"].to_numpy()[order]
    share = {k: total.get(k, 0) / max(1, int((ys == k).sum())) for k in (0, 1)}
    texts = rows["text"].take(pa.array(order)).to_pylist()
    return train(texts, ys.tolist(), [share[int(k)] for k in ys])


def with_score(df: DataFrame, model: Model, text: str = "text", into: str = "score") -> DataFrame:
    """``df`` with the score of each whole text; null and empty texts score by the bias alone.

    A column already named ``into`` is replaced; all rows stay.
    """
    df = df.drop(*[c for c in df.columns if c.lower() == into.lower()])
    out = T.StructType([*df.schema.fields, T.StructField(into, T.DoubleType())])
    shared = df.sparkSession.sparkContext.broadcast(model)  # one float a bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            made, start, held = [], 0, 0
            for i, t in enumerate(texts):
                held += len(t or "")
                if held >= BLOCK_CHARS or i + 1 == len(texts):
                    made.append(scores(texts[start : i + 1], shared.value))
                    start, held = i + 1, 0
            column = pa.array(np.concatenate(made) if made else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, column], schema=batch.schema.append(pa.field(into, pa.float64())))

    return df.mapInArrow(run, out)


def op2_subword_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


QUERIES = {"op2_subword_toxicity": op2_subword_toxicity}
