"""Leads and counts around answers: who may import something, what covers an opportunity, previews, coordinates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratagraph.functions import columns as C


def import_leads(imports: DataFrame, symbols: DataFrame, linked: DataFrame) -> DataFrame:
    """(symbol, importer, relation): modules that import a symbol's module, in its repository or by a package that leads to it.

    ``imports`` (importer, repo, target, names array or null), ``symbols`` (symbol, repo, module, name), ``linked``
    (consumer, package, provider repository).  Imported names must include the symbol's, if any are given.  These are
    leads and no calls.
    """
    said = F.coalesce(F.size(F.filter("names", lambda n: n != "")), F.lit(0))
    rows = imports.withColumn("all", said <= 0)
    same = rows.join(symbols, (rows["repo"] == symbols["repo"]) & (rows["target"] == symbols["module"]))
    same = same.where(F.col("all") | F.array_contains("names", F.col("name"))).select("symbol", "importer", F.lit("same_repo").alias("relation"))
    by = rows.join(linked, (rows["repo"] == linked["consumer"]) & (C.package_name(F.substring_index(rows["target"], ".", 1)) == C.package_name(linked["package"])))
    by = by.select("importer", "target", "names", "all", F.col("provider").alias("repo"))
    cross = by.join(symbols, "repo").where((F.col("target") == F.col("module")) & (F.col("all") | F.array_contains("names", F.col("name"))))
    return same.union(cross.select("symbol", "importer", F.lit("cross_repo").alias("relation"))).distinct()


def covered(opportunities: DataFrame, coverage: DataFrame) -> DataFrame:
    """The ``opportunities`` (repo, predicate, language, path, line) that a row of ``coverage`` (repo, predicate, language, path, path_prefix, line) speaks of.

    An equi join on repository and predicate; a language in a list with slashes, an exact path or a folder above it, and a
    line must fit where the row gives them.
    """
    o, c = opportunities.alias("o"), coverage.alias("c")
    language = F.col("c.language").isNull() | F.array_contains(F.transform(F.split("c.language", "/"), lambda s: F.trim(s)), F.col("o.language"))
    folder = F.rtrim(F.col("c.path_prefix"), F.lit("/"))
    under = (folder == ".") | (F.col("o.path") == folder) | F.startswith(F.col("o.path"), F.concat(folder, F.lit("/")))
    path = F.when(F.col("c.path").isNotNull(), F.col("c.path") == F.col("o.path")).otherwise(F.col("c.path_prefix").isNull() | ((folder != "") & under))
    line = F.col("c.line").isNull() | (F.col("c.line") == F.col("o.line"))
    return o.join(c, (F.col("o.repo") == F.col("c.repo")) & (F.col("o.predicate") == F.col("c.predicate")) & language & path & line, "left_semi")


def candidate_previews(candidates: DataFrame, calls: DataFrame, samples: int = 3) -> DataFrame:
    """(node, callers, sample, rank): of each candidate (node, label) how many callers it has and the first of them by name; most callers first.

    ``calls`` (src_label, dst).  Samples are ranked before they are gathered, so no candidate's callers are collected.
    """
    met = calls.join(candidates.select("node"), calls["dst"] == candidates["node"]).select("node", "src_label").distinct()
    counts = met.groupBy("node").agg(F.count("*").alias("callers"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("src_label"))
    first = met.withColumn("place", place).where(F.col("place") <= samples).groupBy("node").agg(F.array_join(F.array_sort(F.collect_list("src_label")), ",").alias("sample"))
    rows = candidates.join(counts, "node", "left").join(first, "node", "left").select("node", "label", F.coalesce("callers", F.lit(0)).alias("callers"), F.coalesce("sample", F.lit("")).alias("sample"))
    return rows.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("callers"), "label", "node")))  # candidates are few


def importers(imports: DataFrame, package: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """(importers, counts): modules that import a package, the first ones by name, and how many each repository has."""
    rows = imports.where(C.package_name("target") == C.package_name(F.lit(package))).select("importer", "repo").distinct()
    return rows.orderBy("importer", "repo").limit(limit), rows.groupBy("repo").agg(F.count("*").alias("importers"))


def kind_counts(linked: DataFrame, unlinked: DataFrame) -> DataFrame:
    """(state, kind, n) of deploys (deploy_type, target_type, source_kind) and of references to domains (source_kind, domain)."""
    a = linked.select(F.lit("linked").alias("state"), C.deploy_kind("deploy_type", "target_type", "source_kind").alias("kind"))
    b = unlinked.select(F.lit("unlinked").alias("state"), C.reference_kind("source_kind", "domain").alias("kind"))
    return a.union(b).where("kind IS NOT NULL").groupBy("state", "kind").agg(F.count("*").alias("n"))


def coordinates(groups: list[DataFrame], limit: int) -> DataFrame:
    """(repo, path, line_start, line_end): the different valid coordinates of several groups, earlier groups first."""
    columns = ["repo", "path", "line_start", "line_end"]
    tagged = [g.select(*columns, F.lit(i).alias("place")) for i, g in enumerate(groups)]
    valid = (F.coalesce("path", F.lit("")) != "") & (F.col("line_start") > 0) & (F.col("line_end") >= F.col("line_start"))
    rows = reduce(DataFrame.unionByName, tagged).where(valid).groupBy(*columns).agg(F.min("place").alias("place"))
    return rows.orderBy("place", *columns).limit(limit).select(*columns)


def anchored(rows: DataFrame, names: dict[str, str], wanted: str) -> DataFrame:
    """(anchor, match, n, exact): what a text names, by kind of anchor: columns of ``rows`` that contain it, with how many rows each value has."""
    text = wanted.strip().lower()
    found = []
    for anchor, column in names.items():
        hit = rows.where(F.contains(F.lower(column), F.lit(text))).groupBy(F.col(column).alias("match")).agg(F.count("*").alias("n"))
        found.append(hit.select(F.lit(anchor).alias("anchor"), "match", "n", (F.lower("match") == text).alias("exact")))
    return reduce(DataFrame.union, found)


def inspection_terms(labels: list[str], paths: list[str], most: int = 8) -> dict:
    """What to search for, and where: the words of names, and folders, each once and bounded."""
    words = [w for label in labels for w in (label, label.rsplit(".", 1)[-1])]
    folders = [p.rsplit("/", 1)[0] if "/" in p else p for p in paths]
    first = lambda xs: list(dict.fromkeys(x.strip() for x in xs if x and x.strip()))[:most]
    return {"search_terms": first(words), "path_hints": first(folders)}
