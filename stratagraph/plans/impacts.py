"""Queries of what a change touches, over the supplied tables read as models, handlers and namespaces."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.operators import impact

from .projections import table
from .snapshots import SYMBOLS

# Of each ten parts the one at place 1 is a model, 4 to 6 its fields, 7 to 9 what uses it; 0 handles an endpoint.
SUPPORT = f"""SELECT f.predicate, f.subject_id, a.repo AS subject_repo, a.module AS subject_module, a.qualname AS subject_qualname, f.object_id, b.repo AS object_repo, b.module AS object_module,
  b.qualname AS object_qualname, f.access_level FROM (
  SELECT 'DECLARES_FIELD' AS predicate, 's' || (g * 10 + 1) AS subject_id, 's' || k AS object_id, CAST(NULL AS STRING) AS access_level FROM x WHERE place BETWEEN 4 AND 6
  UNION ALL SELECT 'RELATES_TO_MODEL', 's' || k, 's' || (g * 10 + 11), NULL FROM x WHERE place = 4
  UNION ALL SELECT 'RELATES_TO_MODEL', 's' || k, 's' || (g * 10 - 19), NULL FROM x WHERE place = 5 AND g % 2 = 0
  UNION ALL SELECT 'SERIALIZES_MODEL', 's' || k, 's' || (g * 10 + 1), NULL FROM x WHERE place = 7
  UNION ALL SELECT 'HANDLES_MODEL', 's' || k, 's' || (g * 10 + 1), NULL FROM x WHERE place = 8
  UNION ALL SELECT 'TASK_USES_MODEL', 's' || k, 's' || (g * 10 + 1), NULL FROM x WHERE place = 9
  UNION ALL SELECT 'HANDLES_ENDPOINT', 's' || (g * 10 + 1), 's' || k, NULL FROM x WHERE place = 0
  UNION ALL SELECT 'APPLIES_AUTHZ_POLICY', 's' || (g * 10 + 1), 's' || k, CASE WHEN g % 2 = 0 THEN 'public' ELSE 'authenticated' END FROM x WHERE place = 3 AND g % 3 = 0
  UNION ALL SELECT 'USES_AUTHZ_CHECK', 's' || k, 's' || (g * 10 + 3), CASE WHEN g % 4 = 0 THEN 'public' END FROM x WHERE place = 2 AND g % 2 = 0
) f JOIN y a ON a.id = f.subject_id JOIN y b ON b.id = f.object_id"""
CHANGED = "SELECT 's' || k AS symbol_id, repo, module, qualname FROM x WHERE (place = 4 AND g % 11 = 3) OR (place = 2 AND g % 13 = 5) OR (place = 7 AND g % 17 = 1)"
ROOT, REPO = "pkg3", "org/r3"


def _symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SYMBOLS, part=table(spark, sf_dir, "part"))


def _support(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    x = _symbols(spark, sf_dir)
    y = x.select(F.concat(F.lit("s"), "k").alias("id"), "repo", "module", "qualname")
    put = lambda text: text.replace("FROM x", "FROM {x}").replace("JOIN y", "JOIN {y}")
    return spark.sql(put(SUPPORT), x=x, y=y), spark.sql(put(CHANGED), x=x)


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols by modules with telling names; the modules' last parts are words of roles."""
    x = _symbols(spark, sf_dir)
    words = F.array(*[F.lit(w) for w in ("views", "tasks", "models", "serializers", "misc", "tests", "management.commands", "pkg3s")])
    module = F.concat_ws(".", F.substring_index("module", ".", 1), F.element_at(words, (F.col("g") % 8 + 1).cast("int")))
    rows = x.select(F.concat(F.lit("s"), "k").alias("entity_id"), F.lit("CodeSymbol").alias("kind"), "repo", module.alias("module"), "qualname", "symbol_kind")
    return rows.withColumns({"path": F.concat(F.lit("src/"), F.translate("module", ".", "/"), F.lit(".py")), "label": F.concat_ws(".", "module", "qualname")})


def framework_models(spark, sf_dir):
    return impact.impacted_models(*_support(spark, sf_dir))


def framework_sections(spark, sf_dir):
    rows, changed = _support(spark, sf_dir)
    return impact.framework_sections(rows, impact.impacted_models(rows, changed)).select("section", "subject_id", "object_id")


def framework_paths(spark, sf_dir):
    rows, changed = _support(spark, sf_dir)
    return impact.model_paths(rows, impact.impacted_models(rows, changed)).select(F.array_join("path", ">").alias("path"), "field").distinct()


def authz_endpoints(spark, sf_dir):
    return impact.endpoint_authorization(_support(spark, sf_dir)[0])


def authz_leads(spark, sf_dir):
    return impact.authz_leads(impact.endpoint_authorization(_support(spark, sf_dir)[0]))


def application_surfaces(spark, sf_dir):
    return impact.application_surfaces(_entities(spark, sf_dir), REPO, [ROOT]).select("entity_id", "role")


def cross_repo_leads(spark, sf_dir):
    return impact.cross_repo_leads(_entities(spark, sf_dir), REPO, [ROOT], 60).select("repo", "entity_id", "terms", "basis", "round")


QUERIES = {f.__name__: f for f in (framework_models, framework_sections, framework_paths, authz_endpoints, authz_leads, application_surfaces, cross_repo_leads)}

_S = f"""WITH x AS ({SYMBOLS.format(part="part")}), y AS (SELECT 's' || k AS id, * FROM x), r AS ({SUPPORT.replace("AS STRING)", "AS VARCHAR)")}), c AS ({CHANGED}),
m AS (SELECT DISTINCT id AS model FROM (
  SELECT subject_id AS id FROM r WHERE predicate = 'DECLARES_FIELD' AND subject_id IN (SELECT symbol_id FROM c) UNION ALL SELECT object_id FROM r WHERE predicate IN ('RELATES_TO_MODEL', 'SERIALIZES_MODEL', 'HANDLES_MODEL', 'TASK_USES_MODEL')
    AND object_id IN (SELECT symbol_id FROM c)
  UNION ALL SELECT subject_id FROM r WHERE predicate = 'DECLARES_FIELD' AND object_id IN (SELECT symbol_id FROM c)
  UNION ALL SELECT object_id FROM r WHERE predicate IN ('SERIALIZES_MODEL', 'HANDLES_MODEL', 'TASK_USES_MODEL') AND subject_id IN (SELECT symbol_id FROM c)
  UNION ALL SELECT object_id FROM r JOIN c ON c.repo = object_repo AND c.module = object_module AND starts_with(c.qualname, object_qualname || '.') WHERE predicate IN ('RELATES_TO_MODEL', 'SERIALIZES_MODEL', 'HANDLES_MODEL', 'TASK_USES_MODEL')
  UNION ALL SELECT object_id FROM r JOIN c ON c.repo = subject_repo AND c.module = subject_module AND starts_with(c.qualname, subject_qualname || '.') WHERE predicate IN ('SERIALIZES_MODEL', 'HANDLES_MODEL', 'TASK_USES_MODEL')))"""
_AUTHZ = f"""{_S}, h AS (SELECT DISTINCT object_id AS endpoint, subject_id AS handler, subject_module AS module, subject_qualname AS qualname FROM r WHERE predicate = 'HANDLES_ENDPOINT'),
said AS (SELECT DISTINCT endpoint, handler, predicate, r.subject_id, r.object_id, r.access_level FROM h JOIN r ON r.predicate IN ('APPLIES_AUTHZ_POLICY', 'USES_AUTHZ_CHECK') AND (r.subject_id = handler
  OR (r.subject_module = h.module AND starts_with(r.subject_qualname, h.qualname || '.') AND NOT contains(substr(r.subject_qualname, length(h.qualname) + 2), '.')))),
per AS (SELECT endpoint, handler, count(*) FILTER (predicate = 'APPLIES_AUTHZ_POLICY') AS policies, count(*) FILTER (predicate = 'USES_AUTHZ_CHECK') AS checks, bool_or(access_level = 'public') AS pub, bool_or(access_level <> 'public') AS other FROM said GROUP BY 1, 2),
a AS (SELECT endpoint, handler, CASE WHEN coalesce(pub, false) AND NOT coalesce(other, false) THEN 'declared_public' WHEN policies + checks > 0 THEN 'authz_evidence_found' ELSE 'missing_declared_policy' END AS status,
  coalesce(pub, false) AS public, coalesce(policies, 0) AS policies, coalesce(checks, 0) AS checks FROM (SELECT DISTINCT endpoint, handler FROM h) LEFT JOIN per USING (endpoint, handler))"""
_E = f"""WITH x AS ({SYMBOLS.format(part="part")}), e AS (SELECT 's' || k AS entity_id, repo, split_part(module, '.', 1) AS top, ['views', 'tasks', 'models', 'serializers', 'misc', 'tests', 'management.commands', 'pkg3s'][g % 8 + 1] AS word, qualname FROM x)"""

ORACLES = {
    "framework_models": f"{_S} SELECT model FROM m",
    "framework_sections": f"""{_S}, own AS (SELECT object_id FROM r WHERE predicate = 'DECLARES_FIELD' AND subject_id IN (FROM m))
SELECT DISTINCT CASE predicate WHEN 'DECLARES_FIELD' THEN 'model_fields' WHEN 'RELATES_TO_MODEL' THEN 'model_relations' WHEN 'SERIALIZES_MODEL' THEN 'serializers' WHEN 'HANDLES_MODEL' THEN 'views' ELSE 'tasks' END AS section, subject_id, object_id
FROM r WHERE (predicate = 'DECLARES_FIELD' AND subject_id IN (FROM m)) OR (predicate IN ('RELATES_TO_MODEL', 'SERIALIZES_MODEL', 'HANDLES_MODEL', 'TASK_USES_MODEL') AND object_id IN (FROM m))
OR (predicate = 'RELATES_TO_MODEL' AND subject_id IN (FROM own))""",
    "framework_paths": f"""{_S}, t AS (SELECT subject_id AS field, max(object_id) AS dst FROM r WHERE predicate = 'RELATES_TO_MODEL' GROUP BY 1), ed AS (SELECT DISTINCT r.subject_id AS src, t.field, t.dst FROM r JOIN t ON t.field = r.object_id WHERE predicate = 'DECLARES_FIELD'),
one AS (SELECT [model, dst] AS path, field, dst FROM m JOIN ed ON src = model), fresh AS (SELECT dst AS node, min(path) AS path FROM one WHERE dst NOT IN (FROM m) GROUP BY 1),
two AS (SELECT list_append(path, dst) AS path, field FROM fresh JOIN ed ON src = node)
SELECT DISTINCT array_to_string(path, '>') AS path, field FROM (SELECT path, field FROM one UNION ALL SELECT path, field FROM two)""",
    "authz_endpoints": f"{_AUTHZ} SELECT * FROM a",
    "authz_leads": f"""{_AUTHZ}, l AS (SELECT endpoint, handler, CASE WHEN status = 'declared_public' THEN 'declared_public' WHEN public THEN 'public_policy_present' WHEN status = 'missing_declared_policy' THEN 'missing_declared_policy' END AS lead FROM a)
SELECT *, CASE lead WHEN 'declared_public' THEN 100 WHEN 'missing_declared_policy' THEN 80 ELSE 75 END::INT AS priority FROM l WHERE lead IS NOT NULL""",
    "application_surfaces": f"""{_E} SELECT entity_id, CASE word WHEN 'views' THEN 'api' WHEN 'serializers' THEN 'serializer' WHEN 'tasks' THEN 'worker' WHEN 'management.commands' THEN 'scheduled_job' WHEN 'models' THEN 'model' END AS role
FROM e WHERE repo = '{REPO}' AND top = '{ROOT}'""",
    "cross_repo_leads": f"""{_E}, l AS (SELECT repo, entity_id, CASE WHEN top = 'pkg3' AND word = 'pkg3s' THEN 'pkg3' WHEN top = 'pkg3' THEN 'pkg3' END AS terms, top || '.' || word || '.' || qualname AS label FROM e WHERE repo <> '{REPO}' AND word <> 'tests')
SELECT repo, entity_id, terms, 'name_derived_unlinked_lead' AS basis, round FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY label, entity_id)::INT AS round FROM l WHERE terms IS NOT NULL) ORDER BY round, repo LIMIT 60""",
}
