"""A training corpus from documents: STAGES in order, each one's rows written and reread as the next one's documents.

Kept rows and columns are those of documents, but for the last stage, which adds
``shard`` and ``slot``.  A stage works on all that its predecessor kept.  Null
ids, texts and other columns pass through as each operator's docstring says.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.llm import decontamination, mixing, nearcopies, repetition, scratch, sharding
from stratagraph.llm.columns import free

WORDS = 5  # of a shingle in the near-duplicate stage
N_SHARDS = 40


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _stage(f: Stage) -> Stage:
    """``f``, after deleting the scratch tables of stages before it: their rows are written by then."""

    @wraps(f)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with scratch.scope("stages"):
            scratch.release(spark, docs)
            return f(spark, docs, sf_dir)

    return run


@_stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text passes the quality rules, suffix-array repetition among them."""
    (stats,) = free(docs, "__stats")
    _, kept = repetition.verdict(stats)
    return repetition.with_repetition(docs, "text", stats).where(kept).drop(stats)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the smallest id, of each group of near copies: SimHash of five-word shingles, similarity 0.8 and more."""
    return nearcopies.one_of_each(docs, "text", "doc_id", WORDS)


@_stage
def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose text holds no benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    (hits,) = free(docs, "__hits")
    return decontamination.with_hits(docs, benchmark, into=hits).where(F.size(hits) == 0).drop(hits)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the rates say that bring the domains to their targets."""
    return mixing.resampled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


@_stage
def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in N_SHARDS contiguous shards of near equal bytes, in the order of doc_id."""
    return sharding.contiguous_shards(docs, N_SHARDS, [F.col("doc_id")], F.octet_length("text"))


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminate", decontaminate),
    ("mix", mix),
    ("shards", shards),
]

#: SQL can express neither the latent search nor the fitted rates; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with scratch.scope(f"run-{uuid.uuid4().hex}"):  # another run doesn't delete what this one's result reads
        for name, stage in STAGES[:-1]:
            out = stage(spark, docs, sf_dir)
            path = scratch.new_path(spark, f"stage-{name}")
            out.write.option("compression", "zstd").parquet(path)
            docs = spark.read.parquet(path)
        return STAGES[-1][1](spark, docs, sf_dir)
