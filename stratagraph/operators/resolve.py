"""Lookups that report ambiguity instead of guessing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_tier(symbols: DataFrame, query: str, name: str = "name", qualified: str = "qualified", order: tuple[str, ...] = ("qualified",), limit: int = 100) -> DataFrame:
    """Matches of ``query`` in the best tier that has any: exact_qualified, exact_name, then fuzzy (contains).

    Adds ``tier``, ``matches`` (how many in all) and ``resolution``: resolved for one, ambiguous for more.
    """
    q = F.lit(query)
    tier = (
        F.when(F.col(qualified) == q, 0).when(F.col(name) == q, 1).when(F.contains(F.lower(F.col(qualified)), F.lower(q)), 2)
    )
    found = symbols.withColumn("t", tier).where("t IS NOT NULL")
    best = found.agg(F.min("t").alias("best"), F.count("*").alias("n")).select("best")  # one row
    kept = found.join(F.broadcast(best), F.col("t") == F.col("best"))
    total = kept.agg(F.count("*").alias("matches"))
    names = F.array(F.lit("exact_qualified"), F.lit("exact_name"), F.lit("fuzzy"))
    return (
        kept.orderBy(*order).limit(limit).crossJoin(F.broadcast(total))  # one row
        .withColumn("tier", F.element_at(names, F.col("t") + 1))
        .withColumn("resolution", F.when(F.col("matches") == 1, "resolved").otherwise("ambiguous"))
        .drop("t", "best")
    )


def target_ambiguity(facts: DataFrame, alias: str, target: str) -> DataFrame:
    """By alias, how many distinct targets have it, and whether that resolves it."""
    n = facts.groupBy(alias).agg(F.count_distinct(target).alias("targets"))
    return n.withColumn("resolution", F.when(F.col("targets") == 1, "resolved").otherwise("ambiguous"))


def in_file(symbols: DataFrame, path: Column, wanted: str, order: tuple[str, ...], limit: int = 100) -> DataFrame:
    """All symbols of one file, in order."""
    return symbols.where(path == wanted).orderBy(*order).limit(limit)


def unique_providers(candidates: DataFrame, consumer: str, provider: str) -> DataFrame:
    """(consumer, providers, provider): the provider where just one is left, else null."""
    found = candidates.groupBy(consumer).agg(F.count_distinct(provider).alias("providers"), F.min(provider).alias("only"))
    return found.select(consumer, "providers", F.when(F.col("providers") == 1, F.col("only")).alias(provider))


def longest_suffix(targets: DataFrame, services: DataFrame, key: str, min_parts: int = 2) -> DataFrame:
    """The longest suffix of each target's parts that some service has, and the services that have it.

    ``targets`` (target, parts: array) and ``services`` (service, ``key``: parts joined by dots).  Gives (target, n_parts,
    services, service): the service where one alone has it, else null.  Suffixes under ``min_parts`` don't count.
    """
    n = F.size("parts")
    suffixes = targets.where(n >= min_parts).select(
        "target", F.explode(F.transform(F.sequence(F.lit(min_parts), n), lambda k: F.struct(k.alias("n_parts"), F.array_join(F.slice("parts", n - k + 1, k), ".").alias(key)))).alias("s")
    )
    hits = suffixes.select("target", "s.*").join(services, key)
    top = hits.withColumn("best", F.max("n_parts").over(Window.partitionBy("target"))).where("n_parts = best")
    found = top.groupBy("target", "n_parts").agg(F.count_distinct("service").alias("services"), F.min("service").alias("only"))
    return found.select("target", F.col("n_parts").cast("long").alias("n_parts"), "services", F.when(F.col("services") == 1, F.col("only")).alias("service"))
