"""Soft-membership mixing: rates that bring domains to target shares of tokens.

A classifier learnt from the labelled table gives each document a posterior
over domains, so a document belongs to several domains in part.  Nonnegative
rates, one a document, are fitted so that the expected tokens of each domain,
sum of rate x tokens x posterior, meet the targets with the least change from
rate 1.  The best rates are max(0, 1 - posterior . dual) for one number a domain,
which Newton's method finds: a pass sums the totals and the Gram matrix of the
documents with positive rates for several lengths of a step, so nothing is
written between steps and a lost task only repeats its rows.

Bound: at most ``MAX_LABELLED`` labelled ids train the classifier, in one task on an
executor, each by one text of ``toxicity.MAX_BYTES`` at most; the driver gets the
model alone, a number a bucket.  Tokens and posteriors are computed in one pass and written; the steps
read those few numbers a document, and the driver gets one vector a task.
"""

from __future__ import annotations

import pickle
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import toxicity
from .columns import free
from .scratch import written

DOMAINS = ("good", "poor", "toxic")
TARGETS = (0.85, 0.12, 0.03)  # shares of all tokens
MAX_LABELLED = 4000
CLOSE = 1e-6  # of all tokens
SOFT = 1e-10  # weight of the dual's square; targets out of reach are met as nearly as can be
LENGTHS = 0.5 ** np.arange(16)  # of a step, tried in one pass

@dataclass
class Classifier:
    """P(toxic), and P(poor) of what isn't toxic; poor texts are told by their marks as well as their words."""

    toxic: toxicity.Model
    poor: toxicity.Model

    def posteriors(self, texts: list[str | None]) -> np.ndarray:
        """A row of DOMAINS a text; a text without words has the models' biases alone."""
        toxic = toxicity.scores(texts, self.toxic)
        poor = toxicity.scores(texts, self.poor, toxicity.VISIBLE) * (1 - toxic)
        return np.column_stack([1 - toxic - poor, poor, toxic])


def train(texts: list[str | None], domain: list[int]) -> Classifier:
    """A classifier for the numbered domains; a domain without rows is next to impossible."""
    rest = [k for k, d in enumerate(domain) if d != 2]
    toxic = toxicity.train(texts, [int(d == 2) for d in domain], [1.0] * len(domain))
    poor = toxicity.train([texts[k] for k in rest], [domain[k] for k in rest], [1.0] * len(rest), toxicity.VISIBLE)
    return Classifier(toxic, poor)


def fit_domains(docs: DataFrame, labels: DataFrame) -> Classifier:
    """From labelled documents: toxic ones, and the rest by quality.  Null ids and labels teach nothing; of several labels the worst counts."""
    known = (
        labels.select("doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id IS NOT NULL AND quality IS NOT NULL AND toxic IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    )
    domain = F.when(F.col("toxic") > 0, 2).when(F.col("quality") > 0, 0).otherwise(1)
    sample = known.select("doc_id", domain.alias("domain")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if held := list(batches):
            rows = pa.Table.from_batches(held)
            order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
            model = train(rows["text"].take(pa.array(order)).to_pylist(), rows["domain"].to_numpy()[order].tolist())
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    made = toxicity.taught(docs, sample, "domain").repartition(1).mapInArrow(run, "model binary")  # as many rows as the sample's limit says
    found = written(made, "model").collect()
    return pickle.loads(found[0]["model"]) if found else train([], [])


def with_posteriors(df: DataFrame, model: Classifier, text: str, n_tokens: str, posterior: str) -> DataFrame:
    """``df`` with each whole text's number of tokens, its words between spaces, and its posterior over DOMAINS."""
    out = T.StructType([*df.schema.fields, T.StructField(n_tokens, T.LongType()), T.StructField(posterior, T.ArrayType(T.DoubleType()))])
    shared = df.sparkSession.sparkContext.broadcast(model)  # a number a bucket and model
    row = pa.list_(pa.float64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            made, start, held = [np.zeros((0, len(DOMAINS)))], 0, 0
            for i, t in enumerate(texts):
                held += len(t or "")
                if held >= toxicity.BLOCK_CHARS or i + 1 == len(texts):
                    made.append(shared.value.posteriors(texts[start : i + 1]))
                    start, held = i + 1, 0
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([len((t or "").split()) for t in texts], pa.int64()), pa.array(list(np.concatenate(made)), row)],
                schema=batch.schema.append(pa.field(n_tokens, pa.int64())).append(pa.field(posterior, row)),
            )

    return df.mapInArrow(run, out)


def rates(posterior: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """The rates of documents after the given steps: each moves against its gradient and is projected to 0 and above."""
    rate = np.ones(len(posterior))
    for step in steps:
        rate = np.maximum(0, rate - posterior @ step)
    return rate


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, len(DOMAINS))


def _total(df: DataFrame, of, size: int) -> np.ndarray:
    """The sum over ``df`` (n_tokens, posterior) of ``of(n_tokens, posterior)``, a vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            total += of(batch.column(0).to_numpy().astype(float), _matrix(batch.column(1)))
        yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array(total)], names=["k", "x"])

    rows = df.mapInArrow(run, "k int, x double").groupBy("k").agg(F.sum("x").alias("x")).collect()  # ``size`` rows
    out = np.zeros(size)
    for r in rows:
        out[r["k"]] = r["x"]
    return out


def fit_rates(members: DataFrame, targets: tuple[float, ...]) -> list[np.ndarray]:
    """The step that brings the expected domain tokens of ``members`` (n_tokens, posterior) to ``targets`` x all tokens.

    Ends when every domain is within CLOSE of its target, or when no length of a Newton step betters the convex
    dual any more; a warning then gives what the nearest totals are off.  Without tokens there are no steps.
    """
    k = len(DOMAINS)
    goal = np.array(targets, float) / sum(targets)

    def passed(duals: np.ndarray) -> tuple[float, list[tuple[np.ndarray, np.ndarray, float]]]:
        """All tokens, and for each dual the domains' totals, the Gram matrix of positive rates and half the sum of squared rates."""

        def sums(n: np.ndarray, p: np.ndarray) -> np.ndarray:
            out = [n.sum()]
            for dual in duals:
                rate = rates(p, [dual])
                held = p[rate > 0]
                out += [*((rate * n) @ p), *(held.T @ (held * n[rate > 0, None])).ravel(), (n * rate**2).sum() / 2]
            return np.array(out)

        size = k + k * k + 1
        whole, *rest = _total(members, sums, 1 + size * len(duals))
        rows = np.array(rest).reshape(-1, size) / (whole or 1)
        return whole, [(r[:k], r[k:-1].reshape(k, k), float(r[-1])) for r in rows]

    dual = np.zeros(k)
    whole, (now,) = passed(dual[None])
    if not whole:
        return []
    cost = lambda d, at: at[2] + goal @ d + SOFT / 2 * (d @ d)
    while np.abs(now[0] - goal).max() > CLOSE:
        slope = goal - now[0] + SOFT * dual
        step = -np.linalg.solve(now[1] + SOFT * np.eye(k), slope)
        tried = dual + LENGTHS[:, None] * step
        _, found = passed(tried)
        costs = [cost(d, at) for d, at in zip(tried, found, strict=True)]
        best = int(np.argmin(costs))
        off, before = (np.abs(goal - at[0] + SOFT * d).max() for d, at in ((tried[best], found[best]), (dual, now)))
        had = cost(dual, now)
        if costs[best] >= had and off >= before:
            break
        stalled = had - costs[best] <= 1e-14 * abs(had) and off >= before / 2
        dual, now = tried[best], found[best]
        if stalled:
            break
    residual = np.abs(now[0] - goal).max()
    if residual > CLOSE:
        warnings.warn(f"no rates meet the targets: the nearest found are off by {residual:.2g} of all tokens", stacklevel=2)
    return [dual]


def with_rates(df: DataFrame, labels: DataFrame, targets: tuple[float, ...] = TARGETS, names: tuple[str, str, str] = ("n_tokens", "posterior", "rate")) -> DataFrame:
    """``df`` (doc_id, text and others) with tokens, posterior and rate.

    Null and empty texts have no tokens and the prior's posterior; rows with equal texts have equal rates.  Columns
    already named so are replaced; an empty table gives an empty result.
    """
    df = df.drop(*[c for c in df.columns if c.lower() in {n.lower() for n in names}])
    model = fit_domains(df, labels)
    n_tokens, posterior, rate = names
    rows = written(with_posteriors(df, model, "text", n_tokens, posterior), "members")
    steps = fit_rates(rows.select(n_tokens, posterior), targets)
    shared = df.sparkSession.sparkContext.broadcast(steps)  # one vector at most
    out = T.StructType([*rows.schema.fields, T.StructField(rate, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = rates(_matrix(batch.column(batch.schema.get_field_index(posterior))), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made)], schema=batch.schema.append(pa.field(rate, pa.float64())))

    return rows.mapInArrow(run, out)


def resampled(df: DataFrame, labels: DataFrame, targets: tuple[float, ...] = TARGETS) -> DataFrame:
    """The rows of ``df``, each as often as its rate says, its columns unchanged.

    A rate of 2.3 gives two rows, and a third if a number drawn from the row's own id and text is below 0.3.
    """
    names = tuple(free(df, "__n_tokens", "__posterior", "__rate"))
    rate = F.col(names[2])
    draw = F.pmod(F.xxhash64(F.lit("mixing"), "doc_id", "text"), F.lit(1 << 30)) / float(1 << 30)
    copies = (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("int")
    (times,) = free(df, "__times")
    return (
        with_rates(df, labels, targets, names)
        .withColumn(times, copies)
        .where(F.col(times) > 0)
        .withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
        .drop(times, *names)
    )


def op1_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's tokens, posteriors and rate."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = with_rates(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return rows.select("doc_id", "n_tokens", *[F.col("posterior")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)], "rate")


QUERIES = {"op1_soft_mixing": op1_soft_mixing}
