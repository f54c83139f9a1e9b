"""Queries of a fleet: packages against repositories, deploy targets against services, and the scores of its cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.operators import cells, packages

from .projections import table

# The tables of a fleet, in SQL that both engines read: parts import libraries, nations provide them.
PACKAGES = """SELECT DISTINCT 'pk' || p_size AS entity_id, 'h/o/r' || (p_partkey % 20) AS consumer, 'Lib_' || p_size AS name,
  CASE WHEN p_size % 10 = 0 THEN 'stdlib' WHEN p_size % 10 < 3 THEN 'third_party' END AS category, CASE WHEN p_size % 10 = 1 THEN 'lib-' || p_size END AS distribution
FROM {part} WHERE p_partkey % 4 = p_size % 4"""
DEPENDENCIES = """SELECT DISTINCT 'h/o/r' || (p_partkey % 20) AS consumer, 'lib.' || p_size AS declared_name,
  CASE p_size % 4 WHEN 0 THEN 'git_url' WHEN 1 THEN 'registry' WHEN 2 THEN 'workspace' ELSE 'other' END AS spec_form,
  CASE WHEN p_size % 4 = 0 THEN 'https://h/o/r' || (p_size % 30) || '.git' END AS target_url, 'requirements.txt' AS manifest_path, CAST(p_size AS INT) AS line_number
FROM {part} WHERE p_size % 3 <> 0"""
PROVIDERS = """SELECT 'h/o/r' || n_nationkey AS repo, 'lib-' || (n_nationkey % 22) AS package_name, CASE WHEN n_nationkey % 2 = 0 THEN 'v' || n_nationkey END AS service,
  'lib_' || (n_nationkey + 25) AS root, 'p' || n_nationkey || '/pyproject.toml' AS manifest_path FROM {nation}"""


def _fleet(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    sql = lambda text, name: spark.sql(text, **{name: table(spark, sf_dir, name)})
    rows = sql(PACKAGES, "part").withColumn("names", F.array("name"))
    providers = sql(PROVIDERS, "nation").withColumn("aliases", F.array("package_name")).withColumn("roots", F.array("root"))
    return rows, sql(DEPENDENCIES, "part"), providers


def package_links(spark, sf_dir):
    return packages.links(*_fleet(spark, sf_dir)).select("entity_id", "state", "provider", "rule", "consumers")


def package_link_facts(spark, sf_dir):
    rows = _fleet(spark, sf_dir)
    return packages.link_facts(packages.links(*rows), rows[2])


def package_link_evidence(spark, sf_dir):
    rows = _fleet(spark, sf_dir)
    return packages.link_evidence(packages.links(*rows), packages.matches(*rows), rows[2])


def package_buckets(spark, sf_dir):
    return packages.classified(*_fleet(spark, sf_dir)).withColumn("line_number", F.col("line_number").cast("string"))


def package_classification(spark, sf_dir):
    """How many packages of how many consumers each bucket and reason has."""
    return package_buckets(spark, sf_dir).groupBy("bucket", "reason").agg(F.count("*").alias("n"), F.count_distinct("entity_id").alias("packages"))


def package_coverage(spark, sf_dir):
    return packages.linkage_coverage(packages.classified(*_fleet(spark, sf_dir)))


def runtime_link_states(spark, sf_dir):
    """Targets named like paths, modules of services, and deploys that exist already."""
    nations = table(spark, sf_dir, "nation")
    targets = nations.select(F.concat(F.lit("t"), "n_nationkey").alias("target"), F.concat(F.lit("/srv/a/"), F.lower("n_name"), F.lit("/app.wsgi")).alias("path"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("nation_"), F.col("s_suppkey") % 40).alias("folder"))
    prefix = F.when(F.col("s_suppkey") % 3 == 0, "a/").otherwise("")
    modules = suppliers.select(F.concat(F.lit("v"), F.col("s_suppkey") % 60).alias("service"), F.concat(prefix, "folder", F.lit("/app.wsgi")).alias("path"))
    existing = suppliers.where("s_suppkey % 60 % 5 = 0").select(F.concat(F.lit("v"), F.col("s_suppkey") % 60).alias("service"), F.concat(F.lit("t"), F.col("s_suppkey") % 40).alias("target"))
    return packages.runtime_links(targets, modules, existing)


CELLS = """SELECT source AS repo, lang AS dimension, doc_id, n_chars, quality, toxic FROM {documents} LEFT JOIN {labels} USING (doc_id)"""
#: metric -> (part, whole, reason) over a cell's documents
METRICS = {
    "inventory": ("count(*)", "10", "NULL"), "meta_coverage": ("count(quality)", "count(*)", "NULL"), "useful_edge": ("count(CASE WHEN doc_id % 11 > 0 THEN 1 END)", "count(*)", "NULL"),
    "freshness": ("count(CASE WHEN n_chars > 200 THEN 1 END)", "count(*)", "NULL"), "extractor_opportunity": ("count(CASE WHEN quality = 1 THEN 1 END)", "count(quality)", "NULL"),
    "evidence_grounding": ("count(CASE WHEN n_chars > 50 THEN 1 END)", "count(*)", "NULL"), "trust_mix": ("count(CASE WHEN doc_id % 3 > 0 THEN 1 END)", "count(*)", "NULL"),
    "silent_gap": ("count(CASE WHEN toxic = 1 THEN 1 END)", "count(toxic)", "CASE WHEN max(doc_id) % 5 = 0 THEN 'linker_stale' END"),
    "identity_health": ("count(CASE WHEN doc_id % 7 <> 0 THEN 1 END)", "count(*)", "NULL"),
}
_PARTS = " UNION ALL ".join(
    f"SELECT repo, dimension, '{m}' AS metric, CAST({p} AS DOUBLE) AS part, CAST({w} AS DOUBLE) AS whole, CAST({r} AS STRING) AS reason FROM cells GROUP BY repo, dimension" for m, (p, w, r) in METRICS.items()
)
BY = ["repo", "dimension"]


def _metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.sql(CELLS, documents=table(spark, sf_dir, "documents"), labels=table(spark, sf_dir, "labels"))
    return cells.metric_rows(spark.sql(_PARTS.replace("FROM cells", "FROM {cells}"), cells=docs), BY)


def cell_metrics(spark, sf_dir):
    return _metric_rows(spark, sf_dir).withColumn("value", F.round("value", 9))


def cell_score(spark, sf_dir):
    return cells.scores(_metric_rows(spark, sf_dir), BY).withColumn("score", F.round("score", 9))


def contract_flags(spark, sf_dir):
    return cells.flags(_metric_rows(spark, sf_dir), BY).select(*BY, F.array_join("flags", ",").alias("flags"))


def fleet_summary(spark, sf_dir):
    rows = _metric_rows(spark, sf_dir)
    return cells.fleet(rows, cells.scores(rows, BY)).withColumn("score", F.round("score", 9))


def file_dimensions(spark, sf_dir):
    """Dimensions of documents by rules on what they import (source), declare (language) and end in (length)."""
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("path"), "source", "lang", "doc_id")
    kinds = (("import", F.col("source")), ("package", F.concat(F.lit("Pkg_"), "lang")), ("extension", F.concat(F.lit("x"), F.col("doc_id") % 4)))
    signals = None
    for kind, value in kinds:
        rows = docs.select("repo", "path", F.lit(kind).alias("kind"), value.alias("value"))
        signals = rows if signals is None else signals.unionByName(rows)
    rules = spark.createDataFrame([("web", "package", "pkg-en"), ("data", "package", "PKG_de"), ("iac", "extension", "X1"), ("web", "extension", "x3")], "dimension string, kind string, value string")
    return cells.dimensions(signals, rules)


QUERIES = {
    f.__name__: f
    for f in (
        package_links, package_link_facts, package_link_evidence, package_buckets, package_classification, package_coverage, runtime_link_states,
        cell_metrics, cell_score, contract_flags, fleet_summary, file_dimensions,
    )
}

_NAME = "regexp_replace(lower(trim({x})), '[-_.]+', '-', 'g')"
_OWN = f"""WITH pk AS ({PACKAGES.format(part="part")}), dep AS (SELECT *, CASE WHEN spec_form = 'git_url' THEN regexp_replace(replace(target_url, 'https://', ''), '[.]git$', '') END AS address,
  {_NAME.format(x="declared_name")} AS key FROM ({DEPENDENCIES.format(part="part")})),
pr AS (SELECT *, {_NAME.format(x="package_name")} AS key, {_NAME.format(x="root")} AS rootkey FROM ({PROVIDERS.format(nation="nation")})),
k AS (SELECT entity_id, consumer, {_NAME.format(x="name")} AS key, category, distribution FROM pk),
declared AS (SELECT DISTINCT k.entity_id, k.consumer, k.key, d.spec_form, d.address, d.manifest_path, d.line_number, (SELECT count(*) FROM pr WHERE repo = d.address) AS at_address
  FROM k JOIN dep d ON d.consumer = k.consumer AND d.key = k.key),
target AS (SELECT entity_id, consumer, min(address) AS provider, min(manifest_path) AS manifest_path, min(line_number) AS line_number FROM declared WHERE at_address = 1 AND address <> consumer GROUP BY 1, 2 HAVING count(*) = 1),
named AS (SELECT k.entity_id, k.consumer, min(pr.repo) AS provider, count(DISTINCT pr.repo) AS n FROM k JOIN pr ON pr.key = k.key AND pr.repo <> k.consumer WHERE (k.entity_id, k.consumer) NOT IN (SELECT (entity_id, consumer) FROM target) GROUP BY 1, 2),
rooted AS (SELECT k.entity_id, k.consumer, min(pr.repo) AS provider, count(DISTINCT pr.repo) AS n FROM k JOIN pr ON pr.rootkey = k.key AND pr.repo <> k.consumer
  WHERE (k.entity_id, k.consumer) NOT IN (SELECT (entity_id, consumer) FROM target) AND (k.entity_id, k.consumer) NOT IN (SELECT (entity_id, consumer) FROM named) GROUP BY 1, 2 HAVING count(DISTINCT pr.repo) = 1),
led AS (SELECT entity_id, consumer, provider, 1 AS n, true AS t FROM target UNION ALL SELECT entity_id, consumer, provider, n, false FROM named UNION ALL SELECT entity_id, consumer, provider, n, false FROM rooted),
ents AS (SELECT entity_id FROM pk GROUP BY 1 HAVING coalesce(bool_or(category IN ('stdlib', 'node_builtin')), false) = false),
per AS (SELECT entity_id, count(*) AS consumers, max(n) AS most, count(*) FILTER (n = 1) AS led, count(DISTINCT provider) FILTER (n = 1) AS ends, min(provider) AS provider, count(*) FILTER (t) AS targets
  FROM (SELECT DISTINCT entity_id, consumer FROM pk) LEFT JOIN led USING (entity_id, consumer) WHERE entity_id IN (FROM ents) GROUP BY 1),
linked AS (SELECT entity_id, CASE WHEN most > 1 THEN 'ambiguous' WHEN led = 0 OR led <> consumers THEN 'none' WHEN ends > 1 THEN 'ambiguous' ELSE 'linked' END AS state, provider AS p,
  CASE WHEN targets = consumers THEN 'manifest_target_repo_match' ELSE 'unique_normalized_package_name_match' END AS r, consumers, targets FROM per)"""
_BUCKETS = f"""{_OWN}, direct AS (SELECT DISTINCT k.entity_id, k.consumer, pr.repo FROM k JOIN pr ON pr.key = k.key AND pr.repo <> k.consumer),
one AS (SELECT entity_id, consumer, count(*) AS declarations, min(spec_form) AS spec_form, min(manifest_path) AS manifest_path, min(line_number) AS line_number, min(address) AS address, max(at_address) AS at_address FROM declared GROUP BY 1, 2),
hits AS (SELECT entity_id, consumer, count(DISTINCT repo) AS hits FROM (SELECT * FROM direct UNION ALL SELECT entity_id, consumer, address FROM one WHERE declarations = 1 AND at_address = 1 AND address <> consumer) GROUP BY 1, 2),
rows AS (SELECT entity_id, consumer, max(category) AS category, max(distribution) AS distribution FROM pk GROUP BY 1, 2),
b AS (SELECT *, coalesce(hits, 0) AS h, (entity_id, consumer) IN (SELECT (entity_id, consumer) FROM direct) AS has_direct FROM rows LEFT JOIN one USING (entity_id, consumer) LEFT JOIN hits USING (entity_id, consumer)),
coded AS (SELECT *, CASE WHEN category IN ('stdlib', 'node_builtin') THEN 1 WHEN declarations > 1 THEN 2 WHEN declarations = 1 AND h = 1 AND at_address > 0 THEN 3 WHEN declarations = 1 AND h = 1 THEN 4 WHEN declarations = 1 AND h > 1 THEN 5
  WHEN declarations = 1 AND spec_form IN ('workspace', 'file_path', 'git_url') THEN 6 WHEN declarations = 1 AND spec_form = 'registry' THEN 7 WHEN declarations = 1 THEN 8
  WHEN category = 'third_party' AND distribution IS NOT NULL AND NOT has_direct THEN 9 ELSE 10 END AS code FROM b),
bucketed AS (SELECT entity_id, consumer, ['builtin_or_stdlib', 'unknown', 'candidate_internal', 'candidate_internal', 'candidate_internal_ambiguous', 'consumer_manifest_external', 'consumer_manifest_external', 'unknown',
  'code_inferred_external', 'unknown'][code] AS bucket, ['extractor classified package as builtin or stdlib', 'multiple consumer manifest dependencies match the imported package',
  'consumer manifest dependency target matches exactly one fleet repo', 'consumer manifest dependency matches exactly one fleet provider', 'consumer manifest dependency matches multiple fleet providers',
  'path, workspace, or git dependency has no matching fleet provider; treating as out-of-fleet', 'registry dependency has no matching fleet provider', 'consumer manifest dependency has unknown spec form',
  'import normalizer classified package as third-party without a consumer manifest dependency', 'code import has no matching consumer manifest dependency'][code] AS reason,
  CASE WHEN declarations = 1 AND code <> 1 THEN spec_form END AS spec_form, CASE WHEN declarations = 1 AND code <> 1 THEN manifest_path END AS manifest_path, CASE WHEN declarations = 1 AND code <> 1 THEN line_number END AS line_number FROM coded)"""
_METRIC = f"""WITH cells AS ({CELLS.format(documents="documents", labels="labels")}), raw AS ({_PARTS.replace("AS STRING)", "AS VARCHAR)")}),
m AS (SELECT repo, dimension, metric, v AS value, CASE WHEN v IS NULL THEN 'n_a' WHEN reason IS NOT NULL THEN 'partial' ELSE 'usable' END AS state, CASE WHEN v IS NULL THEN coalesce(reason, 'no_denominator') ELSE reason END AS reason
  FROM (SELECT *, CASE WHEN whole > 0 THEN least(part / whole, 1.0) END AS v FROM raw)),
s AS (SELECT repo, dimension, CASE WHEN count(*) FILTER (state = 'usable' AND metric <> 'inventory') = 8 THEN (CASE WHEN min(value) FILTER (metric NOT IN ('silent_gap', 'identity_health', 'inventory')) <= 0 THEN 0.0
  ELSE exp(sum(ln(CASE WHEN value > 0 THEN value END)) FILTER (metric NOT IN ('silent_gap', 'identity_health', 'inventory')) / 6) END)
  * max(1 - value) FILTER (metric = 'silent_gap') * max(value) FILTER (metric = 'identity_health') END AS score FROM m GROUP BY 1, 2)"""

ORACLES = {
    "package_links": f"{_OWN} SELECT entity_id, state, CASE WHEN state = 'linked' THEN p END AS provider, CASE WHEN state = 'linked' THEN r END AS rule, consumers FROM linked",
    "package_link_facts": f"""{_OWN} SELECT 'RESOLVES_TO_REPO' AS predicate, entity_id, p AS target, r AS rule FROM linked WHERE state = 'linked'
UNION ALL SELECT 'RESOLVES_TO_SERVICE', entity_id, pr.service, r FROM linked JOIN pr ON pr.repo = p WHERE state = 'linked' AND service IS NOT NULL AND r <> 'manifest_target_repo_match'""",
    "package_link_evidence": f"""{_OWN} SELECT l.entity_id, t.consumer, t.manifest_path AS path, t.line_number AS line FROM linked l JOIN target t USING (entity_id) WHERE state = 'linked' AND r = 'manifest_target_repo_match' AND consumers > 1
UNION ALL SELECT l.entity_id, NULL, coalesce(CASE WHEN targets = 1 AND consumers = 1 THEN t.manifest_path END, pr.manifest_path), coalesce(CASE WHEN targets = 1 AND consumers = 1 THEN t.line_number END, 1)
FROM linked l JOIN pr ON pr.repo = p LEFT JOIN target t ON t.entity_id = l.entity_id AND l.consumers = 1 WHERE state = 'linked' AND NOT (r = 'manifest_target_repo_match' AND consumers > 1)""",
    "package_buckets": f"{_BUCKETS} SELECT * REPLACE (line_number::VARCHAR AS line_number) FROM bucketed",
    "package_classification": f"{_BUCKETS} SELECT bucket, reason, count(*) AS n, count(DISTINCT entity_id) AS packages FROM bucketed GROUP BY 1, 2",
    "package_coverage": f"""{_BUCKETS} SELECT DISTINCT consumer, entity_id, 'partially_instrumented' AS state, reason FROM (SELECT consumer, entity_id, CASE WHEN bucket = 'candidate_internal_ambiguous' THEN 'cross_repo_dependency_ambiguous_provider'
WHEN bucket = 'unknown' THEN 'cross_repo_dependency_unknown_category' WHEN bucket = 'consumer_manifest_external' AND spec_form IN ('workspace', 'file_path', 'git_url') THEN 'cross_repo_dependency_no_provider' END AS reason FROM bucketed) WHERE reason IS NOT NULL""",
    "runtime_link_states": """WITH t AS (SELECT 't' || n_nationkey AS target, 'srv/a/' || lower(n_name) || '/app.wsgi' AS path FROM nation),
m AS (SELECT DISTINCT 'v' || (s_suppkey % 60) AS service, CASE WHEN s_suppkey % 3 = 0 THEN 'a/' ELSE '' END || 'nation_' || (s_suppkey % 40) || '/app.wsgi' AS path FROM supplier),
e AS (SELECT DISTINCT 'v' || (s_suppkey % 60) AS service, 't' || (s_suppkey % 40) AS target FROM supplier WHERE s_suppkey % 60 % 5 = 0),
met AS (SELECT target, service, length(m.path) AS n FROM t JOIN m ON t.path = m.path OR ends_with(t.path, '/' || m.path)),
top AS (SELECT DISTINCT target, service FROM met WHERE n = (SELECT max(n) FROM met i WHERE i.target = met.target))
SELECT target, service, CASE WHEN count(*) OVER (PARTITION BY target) = 1 THEN 'canonical' ELSE 'candidate' END AS state FROM top QUALIFY (service, target) NOT IN (SELECT (service, target) FROM e)""",
    "cell_metrics": f"{_METRIC} SELECT repo, dimension, metric, round(value, 9) AS value, state, reason FROM m",
    "cell_score": f"{_METRIC} SELECT repo, dimension, round(score, 9) AS score FROM s",
    "contract_flags": f"{_METRIC} SELECT repo, dimension, coalesce(string_agg(f, ',' ORDER BY f), '') AS flags FROM (SELECT repo, dimension, CASE WHEN state <> 'usable' THEN concat_ws(':', metric, state, reason) WHEN metric = 'evidence_grounding' AND value < 1 THEN 'evidence_grounding:contract_violation' WHEN metric = 'silent_gap' AND value > 0 THEN 'silent_gap:gap_detected' END AS f FROM m) GROUP BY 1, 2",
    "fleet_summary": f"""{_METRIC}, g AS (SELECT 'fleet' AS "grouping", '' AS name, avg(score) AS score, count(*) AS cells FROM s WHERE score IS NOT NULL UNION ALL SELECT 'repo', repo, avg(score), count(*) FROM s WHERE score IS NOT NULL GROUP BY 2
UNION ALL SELECT 'dimension', dimension, avg(score), count(*) FROM s WHERE score IS NOT NULL GROUP BY 2 UNION ALL SELECT 'metric', metric, CASE WHEN metric = 'silent_gap' THEN 1 - avg(value) ELSE avg(value) END, count(*) FROM m WHERE value IS NOT NULL GROUP BY metric)
SELECT "grouping", name, round(score, 9) AS score, cells FROM g""",
    "file_dimensions": """SELECT source AS repo, doc_id::VARCHAR AS path, string_agg(DISTINCT d, '+' ORDER BY d) AS dimension FROM (SELECT source, doc_id, CASE lang WHEN 'en' THEN 'web' WHEN 'de' THEN 'data' END AS d FROM documents
UNION ALL SELECT source, doc_id, CASE doc_id % 4 WHEN 1 THEN 'iac' WHEN 3 THEN 'web' END FROM documents) WHERE d IS NOT NULL GROUP BY 1, 2""",
}
