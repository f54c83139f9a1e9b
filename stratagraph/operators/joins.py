"""Join shapes: ends of facts, ranges, contracts, hosts, drift."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratagraph.functions import columns as C

from .lineage import cut


def with_ends(facts: DataFrame, entities: DataFrame, key: str, label: str) -> DataFrame:
    """Facts with the labels of both ends; a fact that lacks an end is dropped."""
    names = entities.select(F.col(key).alias("end"), F.col(label).alias("said"))
    out = facts.join(names.withColumnsRenamed({"end": "src", "said": "src_label"}), "src")
    return out.join(names.withColumnsRenamed({"end": "dst", "said": "dst_label"}), "dst")


def touching(facts: DataFrame, targets: DataFrame, side: str) -> DataFrame:
    """Facts whose end ``side`` is one of ``targets`` (node)."""
    return facts.join(targets, facts[side] == targets["node"], "left_semi")


def both(facts: DataFrame, who: str, what: str, a: str, b: str) -> DataFrame:
    """Who holds both ``a`` and ``b``, with the number of facts of each."""
    held = facts.where(F.col(what).isin(a, b)).groupBy(who).agg(
        F.count_if(F.col(what) == a).alias("first_facts"), F.count_if(F.col(what) == b).alias("second_facts")
    )
    return held.where("first_facts > 0 AND second_facts > 0")


def overlapping(spans: DataFrame, ranges: DataFrame, key: str, width: int) -> DataFrame:
    """Pairs of ``spans`` (start, stop) and ``ranges`` (from, to) of one key that share a place; ``enclosing`` where the span holds the range.

    An equi join on key and bins of ``width`` places; a pair meets in each bin that both touch and counts in the first of them alone.
    """
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    left, right = spans.withColumn("bin", bins("start", "stop")), ranges.withColumn("bin", bins("from", "to"))
    met = left.join(right, [key, "bin"]).where("start <= `to` AND `from` <= stop")
    first = F.greatest(F.floor(F.col("start") / width), F.floor(F.col("from") / width))
    return met.where(F.col("bin") == first).drop("bin").withColumn("enclosing", F.expr("start <= `from` AND `to` <= stop"))


def most_specific(pairs: DataFrame, by: list[str]) -> DataFrame:
    """Of the spans met by one range, those that hold no other one of them strictly."""
    inner = pairs.select(*by, F.col("start").alias("s"), F.col("stop").alias("e")).distinct()
    holds = [F.col("start") <= F.col("s"), F.col("e") <= F.col("stop"), F.col("stop") - F.col("start") > F.col("e") - F.col("s")]
    a = pairs.alias("a")
    b = inner.alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in by]
    return a.join(b, [*same, *holds], "left_anti")


def consumers(provided: DataFrame, called: DataFrame) -> DataFrame:
    """Endpoint consumers: equal path shape, equal method or a provider's ANY, another host; an unknown method matches nothing."""
    p, c = provided.alias("p"), called.alias("c")
    method = (F.col("p.method") == F.col("c.method")) | ((F.col("p.method") == "ANY") & F.col("c.method").isNotNull())
    return p.join(c, (F.col("p.shape") == F.col("c.shape")) & method & (F.col("p.host") != F.col("c.host")))


def reconciled(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, left_rows, right_rows, side): matched, left_only or right_only, by a full outer join of grouped keys."""
    a = left.groupBy(key).agg(F.count("*").alias("left_rows"))
    b = right.groupBy(key).agg(F.count("*").alias("right_rows"))
    side = F.when(F.col("left_rows").isNull(), "right_only").when(F.col("right_rows").isNull(), "left_only").otherwise("matched")
    out = a.join(b, key, "full_outer").withColumn("side", side)
    return out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("left_rows", "right_rows")})


MIN_SIMILARITY = 0.78
MIN_LENGTH_RATIO = 0.35


def possible_matches(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(left_key, right_key, similarity): unmatched keys that are much alike, each used once.

    Keys meet by a segment, versions apart, or by their first four letters, so only such pairs are scored.  Left keys
    choose in their order: each the most similar right key that is left, of equally similar ones the larger.  That is the
    one stable match if every right key prefers the smaller left key, so the choice runs in rounds: open left keys ask
    their next right key, which keeps the smallest that asked.
    """

    def pieces(df: DataFrame, into: str) -> DataFrame:
        said = F.array_union(C.key_segments(key), F.array(F.concat(F.lit("^"), F.substring(key, 1, 4))))
        return df.select(F.col(key).alias(into), F.explode(said).alias("piece")).distinct()

    pairs = pieces(left, "left_key").join(pieces(right, "right_key"), "piece")
    n, m = F.char_length("left_key"), F.char_length("right_key")
    pairs = pairs.where(F.least(n, m) / F.greatest(n, m) >= MIN_LENGTH_RATIO).select("left_key", "right_key").distinct()

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            same = [round(SequenceMatcher(None, a, b).ratio(), 3) for a, b in zip(df["left_key"], df["right_key"], strict=True)]
            yield df.assign(similarity=pd.Series(same, dtype="float64"))

    scored = pairs.mapInPandas(score, "left_key string, right_key string, similarity double").where(F.col("similarity") >= MIN_SIMILARITY)
    rest = cut(scored)
    while True:
        asked = rest.groupBy("left_key").agg(F.max(F.struct("similarity", "right_key")).alias("best")).select("left_key", "best.*")
        held = asked.groupBy("right_key").agg(F.min("left_key").alias("holder"))
        refused = cut(asked.join(held, "right_key").where(F.col("left_key") != F.col("holder")).select("left_key", "right_key"))
        if refused.isEmpty():
            return asked.select("left_key", "right_key", "similarity")
        rest = cut(rest.join(refused, ["left_key", "right_key"], "left_anti"))


def drift(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """(key, before, after, change) by a full outer join; a side that lacks the key counts 0."""
    b = before.select(F.col(key).alias("old"), F.col(value).alias("before"))
    a = after.select(F.col(key).alias("new"), F.col(value).alias("after"))
    out = b.join(a, F.col("old").eqNullSafe(F.col("new")), "full_outer").select(F.coalesce("old", "new").alias(key), "before", "after")
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("before", "after")})
    return out.withColumn("change", F.col("after") - F.col("before"))


def paired(rows: DataFrame, by: list[str], arm: str, off: str, on: str, measures: list[str]) -> DataFrame:
    """By pair: off - on for each measure; pairs that lack an arm are left out."""
    a = rows.where(F.col(arm) == off).select(*by, *[F.col(m).alias(f"off_{m}") for m in measures])
    b = rows.where(F.col(arm) == on).select(*by, *[F.col(m).alias(f"on_{m}") for m in measures])
    return a.join(b, by).select(*by, *[(F.col(f"off_{m}") - F.col(f"on_{m}")).alias(f"{m}_saved") for m in measures])
