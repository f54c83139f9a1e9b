"""Bounded walks over edges (src, dst, and a total order).

A walk is a loop of frontier joins.  Each round's frontier is checkpointed, so
plans stay short and a lost executor costs one round; the visited set is an
anti join.  Nothing is collected.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lineage import cut


def reach(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(node, depth): the nodes that ``roots`` (node) reach in ``depth`` steps at most, roots at 0, each at its least."""
    frontier = cut(roots.select("node").distinct())
    found = frontier.withColumn("depth", F.lit(0))
    for d in range(1, depth + 1):
        step = edges.join(frontier, edges["src"] == frontier["node"], "left_semi").select(F.col("dst").alias("node")).distinct()
        frontier = cut(step.join(found, "node", "left_anti"))
        if frontier.isEmpty():
            break
        found = found.union(frontier.withColumn("depth", F.lit(d)))
    return found


def walked_edges(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """``edges`` that a walk of ``depth`` steps takes, with the step ``depth``; edges to known nodes are among them."""
    nodes = reach(edges, roots, depth - 1).select(F.col("node").alias("src"), (F.col("depth") + 1).alias("depth"))
    return edges.join(nodes, "src")


def backward(edges: DataFrame) -> DataFrame:
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)


def impact_tiers(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """By depth, how many nodes reach ``roots``, and how many of them nothing reaches in turn."""
    back = backward(edges)
    nodes = reach(back, roots, depth).where("depth > 0")
    entered = back.select(F.col("src").alias("node")).distinct().withColumn("entered", F.lit(True))
    return nodes.join(entered, "node", "left").groupBy("depth").agg(
        F.count("*").alias("affected"), F.count_if(F.col("entered").isNull()).alias("no_incoming")
    )


def simple_paths(edges: DataFrame, roots: DataFrame, targets: DataFrame, depth: int, limit: int | None = None) -> DataFrame:
    """(path, steps): the ways of ``depth`` edges at most from a root to a target that visit no node twice.

    A walk only goes on to nodes that still reach a target in the steps that are left; shorter ways come first, so no
    round follows the one that completes ``limit`` ways.
    """
    togo = cut(reach(backward(edges), targets, depth).select(F.col("node").alias("there"), F.col("depth").alias("togo")))
    walks = roots.select(F.array(F.col("node")).alias("path"))
    found, n = [], 0
    for d in range(1, depth + 1):
        step = walks.join(edges, F.element_at("path", -1) == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        step = step.join(togo, step["dst"] == togo["there"]).where(F.col("togo") <= depth - d)
        walks = cut(step.select(F.array_append("path", F.col("dst")).alias("path")).distinct())
        there = walks.join(targets, F.element_at("path", -1) == F.col("node"), "left_semi")
        found.append(there.withColumn("steps", F.lit(d)))
        if limit is not None:
            n += there.count()
            if n >= limit:
                break
        walks = walks.join(targets, F.element_at("path", -1) == F.col("node"), "left_anti")
    return reduce(DataFrame.union, found)
