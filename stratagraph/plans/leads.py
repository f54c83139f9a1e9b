"""Queries of leads and counts over the supplied tables read as one snapshot."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratagraph.operators import leads

from .graph import Graph
from .packets import repos, scope_counts
from .projections import table
from .snapshots import SEEN, SNAP, SYMBOLS, snapshot

LIBRARY = "nation_5"


def _symbols(spark, sf_dir):
    return spark.sql(SYMBOLS, part=table(spark, sf_dir, "part"))


def _imports(spark, sf_dir):
    """Modules import other modules of their packages, or a package, some by name."""
    x = _symbols(spark, sf_dir).where("place = 9")
    target = F.when(F.col("g") % 3 == 0, F.concat(F.lit("pkg"), (F.col("g") + 1) % 7, F.lit(".m"), (F.col("g") + 1) % 40)).otherwise(F.concat(F.lit("nation_"), F.col("p_size") % 25))
    names = F.when(F.col("g") % 2 == 0, F.array(F.concat(F.lit("C"), F.col("g") + 1))).otherwise(F.array().cast("array<string>"))
    return x.select(F.concat_ws(":", "repo", "module").alias("importer"), "repo", target.alias("target"), names.alias("names"))


def import_consumer_leads(spark, sf_dir):
    x = _symbols(spark, sf_dir).where("place = 1").select(F.concat(F.lit("s"), "k").alias("symbol"), "repo", "module", F.col("qualname").alias("name"))
    linked = spark.sql("SELECT 'org/r' || a AS consumer, 'pkg' || b AS package, 'org/r' || ((a + b) % 5) AS provider FROM (SELECT explode(sequence(0, 4)) AS a) CROSS JOIN (SELECT explode(sequence(0, 6)) AS b)")  # 35 rows
    return leads.import_leads(_imports(spark, sf_dir), x, linked)


def coverage_matches(spark, sf_dir):
    """Documents as opportunities, labels as coverage rows of several forms."""
    docs = table(spark, sf_dir, "documents").select(
        F.col("source").alias("repo"), F.when(F.col("doc_id") % 2 == 0, "CALLS").otherwise("PARSES").alias("predicate"), F.col("lang").alias("language"),
        F.concat(F.lit("d/"), F.col("doc_id") % 50, F.lit("/f.py")).alias("path"), (F.col("doc_id") % 20).cast("int").alias("line"), "doc_id",
    )
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").where(k % 13 == 0).select(
        F.col("source").alias("repo"), F.when(k % 3 == 0, "CALLS").otherwise("PARSES").alias("predicate"), F.when(k % 2 == 0, F.concat(F.lit("xx / "), "lang")).alias("language"),
        F.when(k % 5 == 0, F.concat(F.lit("d/"), k % 50, F.lit("/f.py"))).alias("path"), F.when(k % 5 == 1, F.concat(F.lit("d/"), k % 50, F.lit("/"))).when(k % 5 == 2, ".").alias("path_prefix"),
        F.when(k % 5 != 1, (k % 20).cast("int")).alias("line"),
    )
    return leads.covered(docs, rows.distinct()).select("doc_id")


def candidate_previews(spark, sf_dir):
    g = Graph(snapshot(spark, sf_dir))
    candidates = g.entities.where("kind = 'CodeSymbol' AND identity['qualname'] = 'f14'").select(F.col("entity_id").alias("node"), "label")
    calls = g._facts("CALLS").select(F.col("subject_label").alias("src_label"), F.col("object_id").alias("dst"))
    return leads.candidate_previews(candidates, calls).withColumn("rank", F.col("rank").cast("long"))


def dependency_importers(spark, sf_dir):
    return leads.importers(_imports(spark, sf_dir), LIBRARY, 100)[1]


def deploy_kind_counts(spark, sf_dir):
    k = F.col("s_suppkey")
    pick = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % len(xs) + 1).cast("int"))
    rows = table(spark, sf_dir, "supplier")
    linked = rows.select(pick("wsgi", "", "kubernetes_job").alias("deploy_type"), pick("zappa_lambda", "ecs").alias("target_type"), pick("", "apache_vhost", "", "", "zappa_domain").alias("source_kind"))
    return leads.kind_counts(linked, rows.select(pick("domain_env", "", "source_domain_literal", "Terraform_literal").alias("source_kind"), pick("10.0.0.1", "x.example", "a.execute-api.eu.amazonaws.com").alias("domain")))


def source_coordinates(spark, sf_dir):
    rows = spark.sql(SEEN, part=table(spark, sf_dir, "part"))
    return leads.coordinates([rows.where("ordinal % 7 = 3"), rows.where("ordinal % 3 = 1"), rows.where("ordinal % 7 = 3").withColumn("line_end", F.lit(0))], 200)


def snapshot_scope(spark, sf_dir):
    return scope_counts(Graph(snapshot(spark, sf_dir)), "org/r1").where("`table` <> 'coverage'")


def snapshot_repos(spark, sf_dir):
    return repos(Graph(snapshot(spark, sf_dir)))


def anchor_matches(spark, sf_dir):
    rows = spark.sql(SYMBOLS, part=table(spark, sf_dir, "part"))
    return leads.anchored(rows, {"repo": "repo", "module": "module", "symbol": "qualname"}, " R1 ")


QUERIES = {
    f.__name__: f
    for f in (import_consumer_leads, coverage_matches, candidate_previews, dependency_importers, deploy_kind_counts, source_coordinates, snapshot_scope, snapshot_repos, anchor_matches)
}

_X = f"WITH x AS ({SYMBOLS.format(part='part')})"
_IMPORTS = f"""{_X}, i AS (SELECT repo || ':' || module AS importer, repo, CASE WHEN g % 3 = 0 THEN 'pkg' || ((g + 1) % 7) || '.m' || ((g + 1) % 40) ELSE 'nation_' || (p_size % 25) END AS target,
  CASE WHEN g % 2 = 0 THEN 'C' || (g + 1) END AS name FROM x WHERE place = 9)"""
ORACLES = {
    "import_consumer_leads": f"""{_IMPORTS}, s AS (SELECT 's' || k AS symbol, repo, module, qualname FROM x WHERE place = 1)
SELECT DISTINCT symbol, importer, 'same_repo' AS relation FROM i JOIN s ON s.repo = i.repo AND s.module = i.target AND (name IS NULL OR name = qualname)
UNION SELECT DISTINCT symbol, importer, 'cross_repo' FROM i JOIN s ON s.module = i.target AND (name IS NULL OR name = qualname) AND starts_with(target, 'pkg')
  AND s.repo = 'org/r' || ((right(i.repo, 1)::INT + substr(split_part(target, '.', 1), 4)::INT) % 5)""",
    "coverage_matches": """WITH o AS (SELECT source AS repo, CASE WHEN doc_id % 2 = 0 THEN 'CALLS' ELSE 'PARSES' END AS p, lang, 'd/' || (doc_id % 50) || '/f.py' AS path, doc_id % 20 AS line, doc_id FROM documents),
c AS (SELECT DISTINCT source AS repo, CASE WHEN doc_id % 3 = 0 THEN 'CALLS' ELSE 'PARSES' END AS p, CASE WHEN doc_id % 2 = 0 THEN lang END AS lang, CASE WHEN doc_id % 5 = 0 THEN 'd/' || (doc_id % 50) || '/f.py' END AS path,
  CASE doc_id % 5 WHEN 1 THEN 'd/' || (doc_id % 50) || '/' WHEN 2 THEN '.' END AS prefix, CASE WHEN doc_id % 5 <> 1 THEN doc_id % 20 END AS line FROM documents WHERE doc_id % 13 = 0)
SELECT doc_id FROM o WHERE EXISTS (SELECT 1 FROM c WHERE c.repo = o.repo AND c.p = o.p AND (c.lang IS NULL OR c.lang = o.lang) AND (c.line IS NULL OR c.line = o.line)
AND CASE WHEN c.path IS NOT NULL THEN c.path = o.path ELSE prefix IS NULL OR prefix = '.' OR starts_with(o.path, prefix) END)""",
    "candidate_previews": f"""{SNAP}, c AS (SELECT entity_id AS node, label FROM ents WHERE qualname = 'f14'), m AS (SELECT DISTINCT node, subject_label FROM joined JOIN c ON object_id = node WHERE predicate = 'CALLS'),
r AS (SELECT *, row_number() OVER (PARTITION BY node ORDER BY subject_label) AS p FROM m), a AS (SELECT node, count(*) AS callers, string_agg(subject_label, ',' ORDER BY subject_label) FILTER (p <= 3) AS sample FROM r GROUP BY 1)
SELECT node, label, coalesce(callers, 0) AS callers, coalesce(sample, '') AS sample, row_number() OVER (ORDER BY coalesce(callers, 0) DESC, label, node) AS rank FROM c LEFT JOIN a USING (node)""",
    "dependency_importers": f"{_IMPORTS} SELECT repo, count(DISTINCT importer) AS importers FROM i WHERE target = '{LIBRARY}' GROUP BY 1",
    "deploy_kind_counts": """WITH a AS (SELECT ['wsgi', '', 'kubernetes_job'][s_suppkey % 3 + 1] AS d, ['zappa_lambda', 'ecs'][s_suppkey % 2 + 1] AS t, ['', 'apache_vhost', '', '', 'zappa_domain'][s_suppkey % 5 + 1] AS s,
  ['domain_env', '', 'source_domain_literal', 'terraform_literal'][s_suppkey % 4 + 1] AS u, ['10.0.0.1', 'x.example', 'gw'][s_suppkey % 3 + 1] AS dom FROM supplier),
l AS (SELECT 'linked' AS state, CASE WHEN d = 'wsgi' OR s = 'apache_vhost' THEN 'apache_wsgi' WHEN s = 'zappa_domain' OR (d = '' AND t = 'zappa_lambda') THEN 'zappa_lambda' WHEN d <> '' THEN d ELSE t END AS kind FROM a
UNION ALL SELECT 'unlinked', CASE u WHEN 'domain_env' THEN 'env_domain_reference' WHEN 'terraform_literal' THEN 'terraform_domain_reference' WHEN '' THEN CASE dom WHEN '10.0.0.1' THEN 'internal_address_reference' WHEN 'gw' THEN 'api_gateway_domain_reference' END END FROM a)
SELECT state, kind, count(*) AS n FROM l WHERE kind IS NOT NULL GROUP BY 1, 2""",
    "source_coordinates": f"""WITH s AS ({SEEN.format(part="part")}), u AS (SELECT repo, path, line_start, line_end, min(CASE WHEN ordinal % 7 = 3 THEN 0 ELSE 1 END) AS p FROM s WHERE ordinal % 7 = 3 OR ordinal % 3 = 1 GROUP BY 1, 2, 3, 4)
SELECT repo, path, line_start, line_end FROM u ORDER BY p, repo, path, line_start, line_end LIMIT 200""",
    "snapshot_scope": f"""{SNAP}, mine AS (SELECT entity_id FROM ents WHERE repo = 'org/r1') SELECT 'entities' AS "table", count(*) AS n FROM mine
UNION ALL SELECT 'facts', count(*) FROM fcts WHERE subject_id IN (FROM mine) OR object_id IN (FROM mine)
UNION ALL SELECT 'evidence', (SELECT count(*) FROM seen WHERE repo = 'org/r1') + (SELECT count(*) FROM fcts JOIN seen ON target_id = subject_id WHERE predicate = 'CALLS' AND repo = 'org/r1')""",
    "snapshot_repos": f"{SNAP} SELECT DISTINCT repo FROM (SELECT repo FROM ents UNION ALL SELECT consumer_repo FROM fcts) WHERE repo IS NOT NULL",
    "anchor_matches": f"""{_X} SELECT 'repo' AS anchor, repo AS match, count(*) AS n, lower(repo) = 'r1' AS exact FROM x WHERE contains(lower(repo), 'r1') GROUP BY repo
UNION ALL SELECT 'module', module, count(*), false FROM x WHERE contains(lower(module), 'r1') GROUP BY module UNION ALL SELECT 'symbol', qualname, count(*), false FROM x WHERE contains(lower(qualname), 'r1') GROUP BY qualname""",
}
