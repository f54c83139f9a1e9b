"""Cells of a fleet, a repository and a dimension each: how they are found, scored, flagged and summed up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.functions import columns as C

#: The metrics whose geometric mean is taken, and the two that scale it.
MEAN = ("freshness", "extractor_opportunity", "evidence_grounding", "meta_coverage", "useful_edge", "trust_mix")
SCALE = ("silent_gap", "identity_health")
STATES = ("usable", "partial", "n_a")


def dimensions(signals: DataFrame, rules: DataFrame) -> DataFrame:
    """(repo, path, dimension): dimensions of files by ``rules`` (dimension, kind, value); several are joined by ``+``.

    ``signals`` (repo, path, kind, value) are what the files import, declare or end in; kinds are import, package,
    manifest and extension.  Packages compare in the rules' own form.
    """
    form = F.when(F.col("kind") == "package", C.dimension_package_name("value")).otherwise(F.lower("value"))
    given = rules.select("dimension", "kind", form.alias("value")).distinct()
    seen = signals.select("repo", "path", "kind", form.alias("value")).distinct()
    hits = seen.join(given, ["kind", "value"]).select("repo", "path", "dimension").distinct()
    return hits.groupBy("repo", "path").agg(F.array_join(F.array_sort(F.collect_set("dimension")), "+").alias("dimension"))


def metric_rows(values: DataFrame, by: list[str]) -> DataFrame:
    """(by, metric, value, state, reason) from ratios (by, metric, part, whole, reason): n_a without a whole, partial with a reason."""
    value = F.when(F.col("whole") > 0, F.least(F.col("part") / F.col("whole"), F.lit(1.0)))
    state = F.when(value.isNull(), "n_a").when(F.col("reason").isNotNull(), "partial").otherwise("usable")
    reason = F.when(value.isNull(), F.coalesce("reason", F.lit("no_denominator"))).otherwise(F.col("reason"))
    return values.select(*by, "metric", value.alias("value"), state.alias("state"), reason.alias("reason"))


def scores(metrics: DataFrame, by: list[str]) -> DataFrame:
    """(by, score): the geometric mean of MEAN x (1 - silent gap) x identity health; null unless all eight are usable."""
    core = metrics.where(F.col("metric").isin(*MEAN, *SCALE))
    usable = core.where("state = 'usable'")
    logs = F.sum(F.when(F.col("metric").isin(*MEAN) & (F.col("value") > 0), F.log("value")))
    zero = F.count_if(F.col("metric").isin(*MEAN) & (F.col("value") <= 0)) > 0
    gap = F.max(F.when(F.col("metric") == "silent_gap", 1 - F.col("value")))
    health = F.max(F.when(F.col("metric") == "identity_health", F.col("value")))
    mean = F.when(zero, 0.0).otherwise(F.exp(logs / len(MEAN)))
    whole = F.count_distinct("metric") == len(MEAN) + len(SCALE)
    out = usable.groupBy(*by).agg(F.when(whole, mean * gap * health).alias("score"))
    return metrics.select(*by).distinct().join(out, by, "left")


def flags(metrics: DataFrame, by: list[str]) -> DataFrame:
    """(by, flags): one string a metric that isn't usable, that leaves facts without evidence, or that leaves gaps."""
    said = (
        F.when(F.col("state") != "usable", F.concat_ws(":", "metric", "state", "reason"))
        .when((F.col("metric") == "evidence_grounding") & (F.col("value") < 1), "evidence_grounding:contract_violation")
        .when((F.col("metric") == "silent_gap") & (F.col("value") > 0), "silent_gap:gap_detected")
    )
    return metrics.groupBy(*by).agg(F.array_sort(F.collect_set(said)).alias("flags"))


def fleet(metrics: DataFrame, cells: DataFrame) -> DataFrame:
    """(grouping, name, score, cells): mean scores of the fleet, its repositories and its dimensions, in one pass."""
    known = cells.where("score IS NOT NULL")
    sets = known.groupingSets([["repo"], ["dimension"], []], "repo", "dimension").agg(F.grouping_id().alias("g"), F.avg("score").alias("score"), F.count("*").alias("cells"))
    name = F.when(F.col("g") == 1, "repo").when(F.col("g") == 2, "dimension").otherwise("fleet")
    worst = metrics.where("value IS NOT NULL").groupBy("metric").agg(F.avg("value").alias("score"), F.count("*").alias("cells"))
    worst = worst.withColumn("score", F.when(F.col("metric") == "silent_gap", 1 - F.col("score")).otherwise(F.col("score")))
    return sets.select(name.alias("grouping"), F.coalesce("repo", "dimension", F.lit("")).alias("name"), "score", "cells").union(
        worst.select(F.lit("metric"), "metric", "score", "cells")
    )


def stale_links(repos: DataFrame, linked: DataFrame) -> bool:
    """Whether the linker saw other commits than the snapshot has: (repo, commit_sha) of both, a fleet's few rows."""
    differ = repos.select("repo", "commit_sha").exceptAll(linked.select("repo", "commit_sha"))
    return not (differ.isEmpty() and linked.select("repo", "commit_sha").exceptAll(repos.select("repo", "commit_sha")).isEmpty())
