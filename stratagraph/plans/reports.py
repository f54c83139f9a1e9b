"""Metric configuration, coverage reports, snapshot baselines and the deltas of paired runs, written as files."""

from __future__ import annotations

import json
import math
import os
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratagraph.operators import cells
from stratagraph.operators.metrics import DERIVATION_WEIGHTS

METRICS = (
    "inventory", "dimension_classification", "freshness", "extractor_opportunity", "evidence_grounding", "meta_coverage", "silent_gap", "trust_mix", "useful_edge",
    "cross_repo_linkage", "identity_health",
)
LOWER_IS_BETTER = ("silent_gap",)


def metric_config(text: str | None = None) -> dict:
    """The configuration in YAML, checked: enabled metrics, days of freshness, and trust weights; all metrics without one."""
    import yaml

    data = yaml.safe_load(text) if text is not None else {"enabled_metrics": list(METRICS), "trust_weights": dict(DERIVATION_WEIGHTS)}
    if not isinstance(data, dict):
        raise ValueError("the metric configuration must be a YAML object")
    enabled = data.get("enabled_metrics")
    if not isinstance(enabled, list) or not enabled:
        raise ValueError("enabled_metrics must be a non-empty list")
    for m in enabled:
        if m not in METRICS:
            raise ValueError(f"unsupported metric: {m}")
        if enabled.count(m) > 1:
            raise ValueError(f"metric given twice: {m}")
    days = (data.get("freshness") or {}).get("default_days", 365)
    if not isinstance(days, int) or isinstance(days, bool) or days <= 0:
        raise ValueError("freshness.default_days must be a positive whole number")
    weights = data.get("trust_weights") or {}
    for k, w in weights.items():
        if k not in DERIVATION_WEIGHTS:
            raise ValueError(f"not a derivation class: {k}")
        if not isinstance(w, int | float) or isinstance(w, bool) or not 0 <= w <= 1:
            raise ValueError(f"trust weight of {k} must be between 0 and 1")
    return {"enabled_metrics": tuple(enabled), "freshness_days": days, "trust_weights": {k: float(w) for k, w in weights.items()}}


def scoped(facts: DataFrame, evidence: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, facts) by dimension: ``files`` (dimension, key) say which evidence (target_type, target_id, key) counts.

    An entity is in scope by its own evidence, a fact by its own or if either end is.
    """
    seen = evidence.join(files, "key").select("dimension", "target_type", F.col("target_id").alias("id")).distinct()
    entities = seen.where("target_type = 'entity'").select("dimension", "id").distinct()
    own = seen.where("target_type = 'fact'").select("dimension", F.col("id").alias("fact_id"))
    ends = facts.select("fact_id", F.explode(F.array_distinct(F.array("subject_id", "object_id"))).alias("id"))
    by_end = ends.join(entities, "id").select("dimension", "fact_id")
    return entities, own.union(by_end).distinct()


def _write(path: Path, text: str) -> None:
    beside = path.with_name(f".{path.name}.tmp")
    beside.write_text(text, encoding="utf-8")
    os.replace(beside, path)


def report(metrics: DataFrame, gaps: DataFrame, run_id: str, expected_repos: int | None = None) -> dict:
    """A fleet's report from metric rows (repo, dimension, metric, value, state, reason) and coverage rows: a row a cell, its flags, worst metrics and gaps."""
    if expected_repos is not None and expected_repos <= 0:
        raise ValueError("expected_repos must be positive when given")
    by = ["repo", "dimension"]
    scores = cells.scores(metrics, by)
    rows = scores.join(cells.flags(metrics, by), by).orderBy(*by)
    fleet = cells.fleet(metrics, scores)
    worst = fleet.where("grouping = 'metric'").orderBy("score", "name").limit(5)
    return {
        "run_id": run_id, "expected_repos": expected_repos, "cells": [r.asDict() for r in rows.collect()],  # a row a repository and dimension
        "fleet": [r.asDict() for r in fleet.where("grouping <> 'metric'").orderBy("grouping", "name").collect()], "worst_metrics": [r.asDict() for r in worst.collect()],
        "gaps": [r.asDict() for r in gaps.orderBy(*gaps.columns).limit(100).collect()],
    }


def as_markdown(payload: dict) -> str:
    out = [f"# Coverage run {payload['run_id']}", "", "| repository | dimension | score | flags |", "|---|---|---|---|"]
    said = lambda x: "n/a" if x is None else f"{x:.3f}"
    out += [f"| {c['repo']} | {c['dimension']} | {said(c['score'])} | {', '.join(c['flags'])} |" for c in payload["cells"]]
    out += ["", "## Worst metrics", ""] + [f"- {w['name']}: {said(w['score'])}" for w in payload["worst_metrics"]]
    return "\n".join([*out, "", "## Gaps", "", *[f"- {json.dumps(g, sort_keys=True)}" for g in payload["gaps"]], ""])


def write_report(payload: dict, folder: str) -> tuple[str, str]:
    """coverage-run.json and coverage-run.md, each moved into place whole."""
    root = Path(folder)
    root.mkdir(parents=True, exist_ok=True)
    _write(root / "coverage-run.json", json.dumps(payload, indent=2, sort_keys=True) + "\n")
    _write(root / "coverage-run.md", as_markdown(payload))
    return str(root / "coverage-run.json"), str(root / "coverage-run.md")


def baseline(tables: dict[str, DataFrame], name: str, errors: int = 0) -> dict:
    """A snapshot in short: how many rows, kinds, predicates, and reasons of coverage; a row without a reason counts as unknown."""
    count = lambda df, c: {r["k"]: r["n"] for r in df.groupBy(c.alias("k")).agg(F.count("*").alias("n")).orderBy("k").collect()}
    reason = F.coalesce(F.nullif(F.col("scope_ref")["reason"], F.lit("")), F.lit("unknown"))
    return {
        "baseline_version": 1, "name": name, "extractor_errors_count": errors, "counts": {n: t.count() for n, t in sorted(tables.items())},
        "entity_kind_counts": count(tables["entities"], F.col("kind")), "fact_predicate_counts": count(tables["facts"], F.col("predicate")), "coverage_reason_counts": count(tables["coverage"], reason),
    }


def drifted(before: dict, after: dict) -> list[tuple[str, str, int, int]]:
    """(section, name, before, after) of each count that differs between two baselines."""
    out = []
    for section in ("counts", "entity_kind_counts", "fact_predicate_counts", "coverage_reason_counts"):
        a, b = before.get(section, {}), after.get(section, {})
        out += [(section, k, a.get(k, 0), b.get(k, 0)) for k in sorted({*a, *b}) if a.get(k, 0) != b.get(k, 0)]
    return out


def half_even(x: float, places: int = 3) -> float:
    """Rounded as Python does, by the number's exact value."""
    return round(x, places) if math.isfinite(x) else x


def write_deltas(rows: DataFrame, path: str, phase: str = "phase") -> dict:
    """Paired deltas as JSON lines, and by phase how many and their rounded means; runs of an evaluation are few."""
    listed = [r.asDict() for r in rows.orderBy(*rows.columns[:2]).collect()]
    _write(Path(path), "".join(json.dumps(r, sort_keys=True, default=str) + "\n" for r in listed))
    out: dict[str, dict] = {}
    for name in sorted({str(r[phase]) for r in listed}):
        mine = [r for r in listed if str(r[phase]) == name]
        saved = [c for c in rows.columns if c.endswith("_saved")]
        known = {c: [r[c] for r in mine if r[c] is not None and not isinstance(r[c], bool)] for c in saved}
        out[name] = {"count": len(mine)} | {c: half_even(sum(v) / len(v)) if v else None for c, v in known.items()}
    return out
