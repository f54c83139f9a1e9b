"""Grouped answers over facts: rankings, summaries, components, promotion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Trust orders, strongest first.  The summary's and the ranking's differ.
SUMMARY_ORDER = ("authoritative_declared", "runtime_observed", "deterministic_static", "manual_override", "inferred_llm")
RANK_ORDER = (
    "authoritative_declared", "manual_override", "authoritative_static", "deterministic_static",
    "runtime_observed", "static_inferred", "candidate", "inferred_llm",
)


def priority(of: str | Column, order: tuple[str, ...]) -> Column:
    """The place of a class counted from the end, from ``len(order)`` for the strongest to 1; 0 for others."""
    col = F.col(of) if isinstance(of, str) else of
    at = F.array_position(F.array(*[F.lit(x) for x in order]), col)
    return F.when(F.coalesce(at, F.lit(0)) > 0, len(order) + 1 - at).otherwise(0)


def top_counts(df: DataFrame, by: str, limit: int, distinct: str | None = None, into: str = "n") -> DataFrame:
    """The most frequent values of ``by``, by rows or by distinct ``distinct``; ties by value."""
    n = F.count_distinct(distinct) if distinct else F.count("*")
    return df.groupBy(by).agg(n.alias(into)).orderBy(F.desc(into), by).limit(limit)


def samples(of: Column, n: int, into: str) -> Column:
    """The first ``n`` distinct values in order.  The set is one group's: group by what bounds it."""
    return F.slice(F.array_sort(F.collect_set(of)), 1, n).alias(into)


def evidence_summary(evidence: DataFrame, target: str, order: str) -> DataFrame:
    """By target: the strongest derivation class (the first seen among equals), its systems, and how many rows."""
    strongest = F.max_by("derivation_class", F.struct(priority("derivation_class", SUMMARY_ORDER), -F.col(order)))
    return evidence.groupBy(target).agg(
        strongest.alias("strongest"), F.count_distinct("source_system").alias("systems"), F.count("*").alias("rows")
    )


def last_wins(df: DataFrame, by: list[str], order: Column, *columns: str) -> DataFrame:
    """By key, the columns of the row that comes last."""
    top = df.groupBy(*by).agg(F.max_by(F.struct(*columns), order).alias("top"))
    return top.select(*by, *[F.col("top")[c].alias(c) for c in columns])


def first_wins(df: DataFrame, by: list[str], order: Column) -> DataFrame:
    """By key, the row that comes first."""
    top = df.groupBy(*by).agg(F.min_by(F.struct(*[F.col(c) for c in df.columns if c not in by]), order).alias("top"))
    return top.select(*by, "top.*")


def promotion(facts: DataFrame, channel: str, corroborating: Column) -> tuple[DataFrame, DataFrame]:
    """(channels, facts) with a status: a channel without any corroborating fact is a candidate, and so is each fact of it."""
    channels = facts.groupBy(channel).agg(F.max(corroborating).alias("corroborated"), F.count("*").alias("facts"))
    channels = channels.withColumn("status", F.when(F.col("corroborated"), "canonical").otherwise("candidate"))
    demoted = channels.where(~F.col("corroborated")).select(channel, F.lit("candidate").alias("demoted"))
    marked = facts.join(demoted, channel, "left").withColumn("status", F.coalesce("demoted", F.lit("canonical"))).drop("demoted")
    return channels, marked


def sides(df: DataFrame, key: str, tests: dict[str, Column]) -> DataFrame:
    """By key, how many rows pass each test, and which tests alone have rows."""
    out = df.groupBy(key).agg(*[F.count_if(t).alias(n) for n, t in tests.items()])
    names = list(tests)
    lacks = reduce(
        lambda acc, n: acc.when((F.col(n) > 0) & reduce(Column.__and__, [F.col(m) == 0 for m in names if m != n]), f"only_{n}"),
        names[1:],
        F.when((F.col(names[0]) > 0) & reduce(Column.__and__, [F.col(m) == 0 for m in names[1:]]), f"only_{names[0]}"),
    )
    return out.withColumn("asymmetry", lacks.otherwise("none"))


def components(streams: dict[str, DataFrame], key: str, value: str) -> DataFrame:
    """Tagged rows of several streams folded by key: rows and distinct values of each stream, and the set of tags."""
    tagged = reduce(DataFrame.unionByName, [df.select(key, value).withColumn("tag", F.lit(t)) for t, df in streams.items()])
    return tagged.groupBy(key).agg(
        F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("categories"),
        *[F.count_if(F.col("tag") == t).alias(f"{t}_rows") for t in streams],
        F.count_distinct(value).alias("values"),
    )
