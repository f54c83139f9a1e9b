"""Ordered choices: ranks, caps, rounds and budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, *order: Column, limit: int, into: str = "rank") -> DataFrame:
    """The first ``limit`` rows by a total order, numbered from 1.  Only those rows meet in one task."""
    top = df.orderBy(*order).limit(limit)
    return top.withColumn(into, F.row_number().over(Window.orderBy(*order)).cast("long"))


def two_buckets(df: DataFrame, known: Column, limit: int, *order: Column) -> DataFrame:
    """Known rows first, then candidates with what is left of the limit."""
    return df.withColumn("bucket", F.when(known, "known").otherwise("candidate")).orderBy(F.desc("bucket"), *order).limit(limit)


def capped(df: DataFrame, by: list[str], n: int, *order: Column) -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n)


def diverse(df: DataFrame, by: str, limit: int, *order: Column) -> DataFrame:
    """The first row of each key, then the first ``limit`` of those."""
    return capped(df, [by], 1, *order).drop("place").orderBy(*order).limit(limit)


def round_robin(df: DataFrame, by: str, limit: int, *order: Column) -> DataFrame:
    """One row of each key a round, in order of (round, key), until ``limit``; adds ``round``."""
    dealt = capped(df, [by], limit, *order).withColumnRenamed("place", "round")  # no key needs more rows than that
    return dealt.withColumn("round", F.col("round").cast("long")).orderBy("round", by).limit(limit)


def within_budget(df: DataFrame, size: str, budget: int, *order: Column, least: int = 1) -> DataFrame:
    """The longest prefix of the order whose sizes sum up to ``budget`` at most; adds ``used``.

    No row is smaller than ``least``, so no more than budget / least rows are looked at.
    """
    head = df.orderBy(*order).limit(budget // least + 1)
    used = head.withColumn("used", F.sum(size).over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)).cast("long"))
    return used.where(F.col("used") <= budget)
