"""All queries over the graph tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules that define QUERIES and, where SQL can express them, ORACLES.
MODULES: tuple[str, ...] = ("symbols", "surfaces", "measures", "scalars", "snapshots", "fleet", "impacts", "leads", "extraction", "resolution")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    for name in MODULES:
        out |= import_module(f"{__package__}.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out: dict[str, str] = {}
    for name in MODULES:
        out |= getattr(import_module(f"{__package__}.{name}"), "ORACLES", {})
    return out
