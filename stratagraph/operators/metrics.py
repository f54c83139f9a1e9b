"""Coverage metrics: ratios over facts, evidence, coverage and opportunities.

A ratio without a denominator is null: it is not applicable, rather than 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The weights of the trust mix.
DERIVATION_WEIGHTS = {
    "authoritative_declared": 1.0, "authoritative_static": 1.0, "deterministic_static": 0.95, "manual_override": 0.9,
    "runtime_observed": 0.85, "static_inferred": 0.7, "candidate": 0.45, "inferred_llm": 0.35,
}
STATUS_WEIGHTS = {"canonical": 1.0, "candidate": 0.5, "demoted": 0.1}


def weight(of: str, weights: dict[str, float]) -> Column:
    """The weight of a value, 0 for others."""
    out = F.when(F.lit(False), 0.0)
    for k, v in weights.items():
        out = out.when(F.col(of) == k, v)
    return out.otherwise(0.0)


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def share(df: DataFrame, test: Column, into: str = "value", by: list[str] | None = None) -> DataFrame:
    """The share of rows that pass the test; unknown doesn't pass."""
    part = F.count_if(F.coalesce(test, F.lit(False)))
    return df.groupBy(*(by or [])).agg(ratio(part.cast("double"), F.count("*").cast("double")).alias(into))


def freshness(evidence: DataFrame, at: str, cutoff: Column) -> DataFrame:
    """The share of known timestamps that aren't before the cutoff."""
    return share(evidence.where(F.col(at).isNotNull()), F.col(at) >= cutoff)


def grounding(facts: DataFrame, evidence: DataFrame, key: str, valid: Column) -> DataFrame:
    """The share of distinct facts that have evidence with a valid coordinate."""
    good = evidence.where(valid).select(key).distinct().withColumn("good", F.lit(True))
    return share(facts.select(key).distinct().join(good, key, "left"), F.col("good"))


def trust_mix(facts: DataFrame, evidence: DataFrame, key: str) -> DataFrame:
    """The mean over facts of status weight x the greatest weight of their evidence, 0 without any."""
    best = evidence.groupBy(key).agg(F.max(weight("derivation_class", DERIVATION_WEIGHTS)).alias("best"))
    trust = weight("status", STATUS_WEIGHTS) * F.coalesce("best", F.lit(0.0))
    return facts.join(best, key, "left").agg(F.avg(trust).alias("value"))


def useful_edge(anchors: DataFrame, facts: DataFrame, key: str, ends: list[str]) -> DataFrame:
    """The share of anchors that are an end of some fact."""
    touched = facts.select(F.explode(F.array(*ends)).alias(key)).distinct().withColumn("touched", F.lit(True))
    return share(anchors.join(touched, key, "left"), F.col("touched"))


def opportunity(opportunities: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """The share of opportunities that something covers."""
    there = covered.select(key).distinct().withColumn("covered", F.lit(True))
    return share(opportunities.join(there, key, "left"), F.col("covered"))


def silent_gap(opportunities: DataFrame, key: str, *known: DataFrame) -> DataFrame:
    """The share of opportunities with neither fact nor coverage."""
    rest = opportunities.withColumn("gap", F.lit(True))
    for df in known:
        rest = rest.join(df.select(key).distinct(), key, "left_anti")
    rest = rest.select(key, "gap").distinct()
    return share(opportunities.join(rest, key, "left"), F.col("gap"))


def geometric_mean(df: DataFrame, by: list[str], value: str, into: str = "score") -> DataFrame:
    """By key: null if any value is, 0 if any is 0, else exp of the mean logarithm."""
    logs = F.exp(F.avg(F.when(F.col(value) > 0, F.log(value))))
    return df.groupBy(*by).agg(
        F.when(F.count_if(F.col(value).isNull()) > 0, None).when(F.min(value) <= 0, 0.0).otherwise(logs).alias(into)
    )
