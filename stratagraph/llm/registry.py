"""The queries of this subpackage, their SQL, and the tables that they read."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Modules that define QUERIES and, where SQL can express them, ORACLES.
MODULES = (
    "alignment",
    "decontamination",
    "mixing",
    "repetition",
    "secrets",
    "sharding",
    "simhash",
    "substrings",
    "toxicity",
    "warc",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    out = {}
    for name in MODULES:
        out |= import_module(f"{__package__}.{name}").QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out = {}
    for name in MODULES:
        out |= getattr(import_module(f"{__package__}.{name}"), "ORACLES", {})
    return out
