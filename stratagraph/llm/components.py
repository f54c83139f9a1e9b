"""Connected components by alternating large-star and small-star steps.

Labels and links stay distributed; the driver sees two numbers a round.  Each
round is written to the shared folder, so a lost executor costs one round.
Minima are pre-aggregated on each task, and joins are left to AQE to split
where a component's hub is hot.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import written


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.hash("u", "v").cast("long"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (columns a, b: long) but the roots.

    The root is the smallest node that can be reached.  Null ends and loops are
    left out, repeated links count once; no edges give an empty result.
    """
    links = edges.where(F.col("a") != F.col("b"))
    links = written(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    before = _mark(links)
    while before[0]:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        links = written(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        after = _mark(links)
        if after == before:
            break
        before = after
    return links.select(F.col("u").alias("node"), F.col("v").alias("root"))
