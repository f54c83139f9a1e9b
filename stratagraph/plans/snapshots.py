"""The supplied tables read as one snapshot, and every verb of ``Graph`` put to it, with SQL for what it must answer.

The projection is SQL that both engines read: parts are symbols, suppliers services, customers endpoints, nations
packages, channels, domains and variables, regions deploy targets.  A verb's answer is a few rows, so its rows become
the query's result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.sources.snapshot import SCHEMAS

from .graph import Graph, aggregation_label, listed
from .projections import CALLS, calls, table

NAMES = ("part", "supplier", "customer", "nation", "region", "labels")
PARTS = "tenant repo module qualname symbol_kind name slug method path host broker_kind channel_address type target".split()


def _row(kind: str, ordinal: str, key: str, source: str, status: str = "'canonical'", **identity: str) -> str:
    cells = ", ".join(f"CAST({identity.get(p, 'NULL')} AS STRING) AS {p}" for p in PARTS)
    return f"SELECT CAST({ordinal} AS BIGINT) AS ordinal, {key} AS entity_id, '{kind}' AS kind, {status} AS canonical_status, {cells} FROM {source}"


SYMBOLS = """SELECT p_partkey AS k, CAST(floor(p_partkey / 10) AS BIGINT) AS g, p_partkey % 10 AS place, p_size, 'org/r' || (CAST(floor(p_partkey / 10) AS BIGINT) % 5) AS repo,
  'pkg' || (CAST(floor(p_partkey / 10) AS BIGINT) % 7) || '.m' || (CAST(floor(p_partkey / 10) AS BIGINT) % 40) AS module,
  CASE p_partkey % 10 WHEN 1 THEN 'C' || CAST(floor(p_partkey / 10) AS BIGINT) WHEN 2 THEN 'C' || CAST(floor(p_partkey / 10) AS BIGINT) || '.__init__' ELSE 'f' || (p_partkey % 50) END AS qualname,
  CASE p_partkey % 10 WHEN 1 THEN 'class' WHEN 2 THEN 'method' WHEN 3 THEN 'async_function' ELSE 'function' END AS symbol_kind FROM {part}"""

ENTITIES = " UNION ALL ".join((
    _row("CodeSymbol", "k", "'s' || k", f"({SYMBOLS}) x", tenant="'t'", repo="repo", module="module", qualname="qualname", symbol_kind="symbol_kind"),
    _row("CodeModule", "min(k)", "'m:' || repo || ':' || module", f"({SYMBOLS}) x", tenant="'t'", repo="repo", module="module") + " GROUP BY repo, module",
    _row("Service", "s_suppkey", "'v' || s_suppkey", "{supplier}", tenant="'t'", repo="'org/r' || (s_suppkey % 5)", slug="'svc-' || s_suppkey"),
    _row("Endpoint", "c_custkey", "'e' || c_custkey", "{customer}", tenant="'t'", repo="'org/r' || (c_custkey % 5)", host="'_'",
         method="CASE c_custkey % 4 WHEN 0 THEN 'GET' WHEN 1 THEN 'POST' WHEN 2 THEN 'ANY' ELSE 'PUT' END",
         path="'/api/' || lower(c_mktsegment) || CASE c_custkey % 2 WHEN 0 THEN '/:id' ELSE '/item-' || (c_custkey % 50) END"),
    _row("ExternalPackage", "n_nationkey", "'p' || n_nationkey", "{nation}", tenant="'t'", name="lower(n_name)"),
    _row("EventChannel", "n_nationkey", "'c' || n_nationkey", "{nation}", status="CASE WHEN n_nationkey % 6 = 5 THEN 'candidate' ELSE 'canonical' END", tenant="'t'", broker_kind="'sqs'", channel_address="lower(n_name)"),
    _row("Domain", "n_nationkey", "'d' || n_nationkey", "{nation}", tenant="'t'", name="lower(n_name) || '.example'"),
    _row("EnvVar", "n_nationkey", "'x' || n_nationkey", "{nation}", tenant="'t'", name="'URL_' || n_name"),
    _row("DeployTarget", "r_regionkey", "'t' || r_regionkey", "{region}", tenant="'t'", type="'kubernetes_deployment'", target="lower(r_name)"),
    _row("Repo", "r_regionkey", "'r' || r_regionkey", "{region}", tenant="'t'", name="'r' || r_regionkey"),
))


def _fact(predicate: str, offset: int, ordinal: str, a: str, b: str, source: str, status: str = "'canonical'", category: str = "NULL", consumer: str = "NULL") -> str:
    return (f"SELECT CAST({offset}000000000 + {ordinal} AS BIGINT) AS ordinal, '{predicate}' AS predicate, {a} AS subject_id, {b} AS object_id, {status} AS canonical_status, "
            f"CAST({category} AS STRING) AS category, CAST({consumer} AS STRING) AS consumer_repo FROM {source}")  # fmt: skip


CATEGORY = "CASE min(k) % 4 WHEN 0 THEN 'stdlib' WHEN 1 THEN 'internal_module' WHEN 2 THEN 'unknown' ELSE 'third_party' END"
FACTS = " UNION ALL ".join((
    "SELECT ordinal, 'CALLS' AS predicate, 's' || src AS subject_id, 's' || dst AS object_id, 'canonical' AS canonical_status, CAST(NULL AS STRING) AS category, CAST(NULL AS STRING) AS consumer_repo FROM {calls}",
    _fact("IMPORTS", 1000, "min(k)", "'m:' || repo || ':' || module", "'p' || (p_size % 25)", f"({SYMBOLS}) x", category=CATEGORY) + " GROUP BY repo, module, p_size % 25",
    *(_fact(p, 2000 + i, "c_custkey", "'v' || (c_custkey % 10)", "'e' || c_custkey", f"{{customer}} WHERE c_custkey % 3 = {i}") for i, p in enumerate(("EXPOSES_ENDPOINT", "CALLS_ENDPOINT", "DOCUMENTS_ENDPOINT"))),
    *(_fact(p, 3000 + i, "s_suppkey", "'v' || s_suppkey", "'c' || s_nationkey", f"{{supplier}} WHERE s_suppkey % 3 = {i}",
            status="CASE WHEN s_suppkey % 11 = 3 THEN 'candidate' ELSE 'canonical' END") for i, p in enumerate(("PRODUCES_EVENT", "CONSUMES_EVENT", "REFERENCES_EVENT_CHANNEL"))),
    _fact("DEPLOYS_VIA_CONFIG", 4000, "s_suppkey", "'v' || s_suppkey", "'t' || (s_nationkey % 5)", "{supplier} WHERE s_suppkey % 2 = 0 AND s_nationkey % 5 < 4",
          status="CASE WHEN s_suppkey % 8 = 4 THEN 'candidate' ELSE 'canonical' END"),
    _fact("ROUTES_DOMAIN_TO_DEPLOY", 5000, "n_nationkey", "'d' || n_nationkey", "'t' || n_regionkey", "{nation} WHERE n_nationkey % 3 <> 0"),
    _fact("REFERENCES_DOMAIN", 6000, "n_nationkey", "'x' || n_nationkey", "'d' || n_nationkey", "{nation}"),
    _fact("REFERENCES_ENV_VAR", 7000, "s_suppkey", "'v' || s_suppkey", "'x' || s_nationkey", "{supplier} WHERE s_suppkey % 2 = 1"),
    _fact("RESOLVES_TO_REPO", 8000, "n_nationkey", "'p' || n_nationkey", "'r' || (n_nationkey % 5)", "{nation} WHERE n_nationkey % 2 = 0", consumer="'org/r' || (n_nationkey % 3)"),
))
SEEN = f"""SELECT k AS ordinal, 's' || k AS target_id, 'src/' || replace(module, '.', '/') || '.py' AS path, repo, CAST(place * 20 + 1 AS INT) AS line_start,
  CAST(place * 20 + CASE WHEN place = 1 THEN 40 ELSE 16 END AS INT) AS line_end FROM ({SYMBOLS}) x"""
STATES = """SELECT doc_id AS ordinal, 'v' || doc_id AS coverage_id, CASE WHEN quality = 1 THEN 'PARSES' ELSE 'CALLS' END AS predicate,
  CASE WHEN quality = 1 AND toxic = 0 THEN 'instrumented' WHEN quality = 1 THEN 'partially_instrumented' WHEN toxic = 0 THEN 'uninstrumented' ELSE 'stale' END AS state FROM {labels}"""


def snapshot(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five tables."""
    frames = {n: table(spark, sf_dir, n) for n in NAMES} | {"calls": calls(spark, sf_dir)}
    sql = lambda text: spark.sql(text, **{n: f for n, f in frames.items() if f"{{{n}}}" in text})
    pairs = F.array(*[F.struct(F.lit(p).alias("key"), F.col(p).alias("value")) for p in PARTS])
    empty = F.create_map().cast("map<string,string>")
    entities = sql(ENTITIES).withColumn("identity", F.map_from_entries(F.filter(pairs, lambda e: e["value"].isNotNull())))
    entities = entities.withColumns({"urn": F.concat(F.lit("urn:"), "entity_id"), "properties": empty})
    said = F.array(*[F.struct(F.lit(p).alias("key"), F.col(p).alias("value")) for p in ("category", "consumer_repo")])
    facts = sql(FACTS).withColumn("qualifier", F.map_from_entries(F.filter(said, lambda e: e["value"].isNotNull())))
    facts = facts.withColumn("fact_id", F.concat_ws(":", "predicate", "subject_id", "object_id"))
    ref = F.struct("repo", F.lit("c0ffee").alias("commit_sha"), "path", "line_start", "line_end")
    evidence = sql(SEEN).select(
        "ordinal", F.concat(F.lit("v:"), "target_id").alias("evidence_id"), F.lit("entity").alias("target_type"), "target_id", F.lit("deterministic_static").alias("derivation_class"),
        F.lit("py").alias("source_system"), empty.alias("source_ref"), ref.alias("bytes_ref"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("ingested_at"),
    )
    called = facts.where("predicate = 'CALLS'").join(evidence.select(F.col("target_id").alias("subject_id"), "bytes_ref"), "subject_id")
    called = called.select(
        "ordinal", F.concat(F.lit("v:"), "fact_id").alias("evidence_id"), F.lit("fact").alias("target_type"), F.col("fact_id").alias("target_id"), F.lit("deterministic_static").alias("derivation_class"),
        F.lit("py").alias("source_system"), empty.alias("source_ref"), "bytes_ref", F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("string").alias("ingested_at"),
    )
    coverage = sql(STATES).select("ordinal", "coverage_id", F.lit("t").alias("tenant_id"), "predicate", empty.alias("scope_ref"), "state", F.lit("py").alias("source_system"), F.lit(None).cast("string").alias("checked_at"))
    made = {"entities": entities, "facts": facts, "support_facts": spark.createDataFrame([], SCHEMAS["support_facts"]), "evidence": evidence.unionByName(called), "coverage": coverage}
    return {n: df.select(*[c.split(" ")[0] for c in _columns(n)]) for n, df in made.items()}


def _columns(name: str) -> list[str]:
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(SCHEMAS[name]).names


def _asked(schema: str, ask: Callable[[Graph], list[dict]]) -> Callable[[SparkSession, str], DataFrame]:
    """A query: the rows of a verb's answer."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = ask(Graph(snapshot(spark, sf_dir)))
        return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema)

    return run


ONE, MANY = "pkg4.m4.C4", "f14"
FILE = "src/pkg4/m4.py"
CALLED = "fact_id string, subject_label string, object_label string"

def g_aggregation_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels that differ between answers and aggregations."""
    rows = Graph(snapshot(spark, sf_dir)).entities.withColumn("counted_as", aggregation_label())
    return rows.where("label <> counted_as").select("entity_id", "label", "counted_as")


QUERIES = {
    "g_aggregation_labels": g_aggregation_labels,
    "g_lookup_symbol": _asked("tier string, match_count long, label string, path string, line_start int", lambda g: [r | a for a in [g.lookup_symbol("C4", limit=50)] for r in a["matches"]]),
    "g_lookup_fuzzy": _asked("tier string, match_count long, label string, path string, line_start int", lambda g: [r | a for a in [g.lookup_symbol("m4.c4", limit=50)] for r in a["matches"]]),
    "g_lookup_at_line": _asked("label string, line_start int, line_end int", lambda g: g.lookup_symbol("__init__", path="./" + FILE, line=45, limit=50)["matches"]),
    "g_symbols_in_file": _asked("entity_id string, label string, line_start int, line_end int", lambda g: g.symbols_in_file(FILE, 500)["symbols"]),
    "g_module_samples": _asked("module string, label string", lambda g: listed(g.module_samples("pkg4", 5))),
    "g_ambiguous": _asked("status string, match_count long, candidates long", lambda g: [a | {"candidates": len(a.get("candidates", []))} for a in [g.find_callers(MANY, limit=500)]]),
    "g_find_callers": _asked(CALLED, lambda g: g.find_callers(ONE, limit=100)["rows"]),
    "g_find_callers_all": _asked(CALLED, lambda g: g.find_callers(MANY, include_all=True, limit=500)["rows"]),
    "g_find_callees": _asked(CALLED, lambda g: g.find_callees(ONE, limit=100)["rows"]),
    "g_blast_radius": _asked("depth int, fact_id string", lambda g: g.blast_radius(ONE, depth=2, limit=500)["edges"]),
    "g_reverse_impact": _asked("depth int, label string, affected boolean", lambda g: g.reverse_impact("pkg4.m4.C4.__init__", depth=1, limit=500)["rows"]),
    "g_evidence_for_call": _asked("evidence_id string, target_id string", lambda g: g.evidence_for_any_call(ONE, 50)),
    "g_modules_importing": _asked("fact_id string, category string", lambda g: g.modules_importing("nation_5", 500)["modules"]),
    "g_who_imports": _asked("prefix string, n long", lambda g: g.who_imports("Nation_5", 1, limit=500)["rows"]),
    "g_dependency_info": _asked("name string, category string, fact_id string", lambda g: g.dependency_info("nation_5")["packages"]),
    "g_top_dependencies": _asked("object_label string, n long", lambda g: g.top_dependencies(25)["dependencies"]),
    "g_top_internal": _asked("object_label string, importers long", lambda g: g.top_internal_dependencies(limit=25)["dependencies"]),
    "g_top_fan_in": _asked("object_label string, callers long", lambda g: g.top_fan_in_symbols(limit=25)["symbols"]),
    "g_importing_both": _asked("subject_label string, first_facts long, second_facts long", lambda g: g.modules_importing_both("nation_5", "nation_12", limit=500)["modules"]),
    "g_cross_repo_links": _asked("fact_id string, subject_label string, object_label string", lambda g: g.cross_repo_links(100)["links"]),
    "g_repo_dependencies": _asked("fact_id string, subject_label string", lambda g: g.repo_dependencies("R1", 100)["links"]),
    "g_domain_references": _asked("fact_id string, predicate string", lambda g: g.domain_references("nation_1", 500)["references"]),
    "g_endpoints": _asked("predicate string, method string, route string, subject_label string", lambda g: g.endpoints("/api/b", 500)["endpoints"]),
    "g_event_channels": _asked("linkage string, predicate string, subject_label string, object_label string", lambda g: g.event_channels("a", 500)["channels"]),
    "g_deploy_mappings": _asked("linkage string, predicate string, subject_label string, object_label string", lambda g: g.deploy_mappings("a", 500)["mappings"]),
    "g_reconcile": _asked("side string, n long", lambda g: [{"side": k, "n": v} for k, v in g.reconcile_contract("c", "endpoint_path", ["DOCUMENTS_ENDPOINT"], ["EXPOSES_ENDPOINT"])["counts"].items()]),
    "g_summary": _asked("section string, name string, n long", lambda g: [{"section": s, "name": k, "n": v} for a in [g.summary()] for s in ("entities", "facts", "coverage") for k, v in a[s].items()]),
    "g_coverage_gaps": _asked("coverage_id string, predicate string, state string", lambda g: g.coverage_gaps(200)["gaps"]),
    "g_service_brief": _asked("predicate string, n long", lambda g: [{"predicate": k, "n": v} for k, v in g.service_brief("svc-99", 500)["counts"].items()] if g.service_brief("svc-99")["status"] == "ok" else []),
    "g_planning_context": _asked("predicate string, direction string, n long", lambda g: g.planning_context("nation_7.example")["counts"]),
    "g_runtime_map": _asked("service string, endpoints long, produced long, consumed long, deploys long", lambda g: g.runtime_map(500)["services"]),
    "g_unlinked_routes": _asked("domain string, target string", lambda g: g.runtime_map(500)["unlinked_routes"]),
    "g_review_symbols": _asked("label string, path string, enclosing boolean", lambda g: g.review([(FILE, 22, 23), (FILE, 45, 46), ("src/pkg0/m0.py", 70, 130)], limit=500)["symbols"]),
}

_SNAP = ", ".join((f"sym AS ({SYMBOLS.format(part='part')})", CALLS))


def _plain(text: str) -> str:
    for n in NAMES:
        text = text.replace(f"{{{n}}}", n)
    return text.replace("{calls}", "calls").replace("AS STRING)", "AS VARCHAR)")


LABEL = """CASE kind WHEN 'CodeSymbol' THEN module || '.' || qualname WHEN 'CodeModule' THEN module WHEN 'Service' THEN slug WHEN 'Endpoint' THEN method || ' ' || path
  WHEN 'EventChannel' THEN broker_kind || ':' || channel_address WHEN 'DeployTarget' THEN type || ':' || target ELSE name END"""
SNAP = f"""WITH {CALLS}, ents AS (SELECT *, {LABEL} AS label FROM ({_plain(ENTITIES)})), fcts AS (SELECT *, predicate || ':' || subject_id || ':' || object_id AS fact_id FROM ({_plain(FACTS)})),
seen AS ({_plain(SEEN)}), cov AS ({_plain(STATES)}),
joined AS (SELECT f.*, a.label AS subject_label, a.kind AS subject_kind, a.repo AS subject_repo, a.canonical_status AS subject_status, b.label AS object_label, b.kind AS object_kind,
  b.canonical_status AS object_status, b.method, b.path, b.repo AS object_repo FROM fcts f JOIN ents a ON a.entity_id = f.subject_id JOIN ents b ON b.entity_id = f.object_id),
syms AS (SELECT e.*, s.path AS file, s.line_start, s.line_end FROM ents e JOIN seen s ON s.target_id = e.entity_id)"""
_CANON = "canonical_status = 'canonical' AND subject_status = 'canonical' AND object_status = 'canonical'"
_SHAPE = "regexp_replace(path, '/:[^/]+', '/{}', 'g')"
_MATCHED = "SELECT '{t}' AS tier, count(*) OVER () AS match_count, label, file AS path, line_start FROM syms WHERE {w} ORDER BY file, line_start, label LIMIT 50"

ORACLES = {
    "g_aggregation_labels": f"""{SNAP}, a AS (SELECT entity_id, label, CASE kind WHEN 'Endpoint' THEN '{{"host":"_","method":"' || method || '","path":"' || path || '","repo":"' || repo || '","tenant":"t"}}'
WHEN 'DeployTarget' THEN '{{"target":"' || target || '","tenant":"t","type":"' || type || '"}}' ELSE label END AS counted_as FROM ents) SELECT * FROM a WHERE label <> counted_as""",
    "g_lookup_symbol": f"{SNAP} {_MATCHED.format(t='exact_name', w="split_part(qualname, '.', -1) = 'C4'")}",
    "g_lookup_fuzzy": f"{SNAP} {_MATCHED.format(t='fuzzy', w="contains(lower(label), 'm4.c4')")}",
    "g_lookup_at_line": f"{SNAP} SELECT label, line_start, line_end FROM syms WHERE split_part(qualname, '.', -1) = '__init__' AND file = '{FILE}' AND 45 BETWEEN line_start AND line_end ORDER BY file, line_start, label LIMIT 50",
    "g_symbols_in_file": f"{SNAP} SELECT entity_id, label, line_start, line_end FROM syms WHERE file = '{FILE}' ORDER BY line_start, label LIMIT 500",
    "g_module_samples": f"{SNAP} SELECT DISTINCT module, label FROM (SELECT module, label, dense_rank() OVER (PARTITION BY module ORDER BY label) AS r FROM ents WHERE kind = 'CodeSymbol' AND starts_with(module, 'pkg4')) WHERE r <= 5",
    "g_ambiguous": f"{SNAP} SELECT 'ambiguous' AS status, count(*) AS match_count, least(count(*), 500) AS candidates FROM syms WHERE qualname = '{MANY}' HAVING count(*) > 1",
    "g_find_callers": f"{SNAP} SELECT fact_id, subject_label, object_label FROM joined WHERE predicate = 'CALLS' AND object_label = '{ONE}' ORDER BY ordinal LIMIT 100",
    "g_find_callers_all": f"{SNAP} SELECT fact_id, subject_label, object_label FROM joined WHERE predicate = 'CALLS' AND object_id IN (SELECT entity_id FROM syms WHERE qualname = '{MANY}' ORDER BY file, line_start, label LIMIT 500) ORDER BY ordinal LIMIT 500",
    "g_find_callees": f"{SNAP} SELECT fact_id, subject_label, object_label FROM joined WHERE predicate = 'CALLS' AND subject_label = '{ONE}' ORDER BY ordinal LIMIT 100",
    "g_blast_radius": f"""{SNAP}, one AS (SELECT object_id, fact_id, ordinal FROM joined WHERE predicate = 'CALLS' AND subject_label = '{ONE}'),
two AS (SELECT fact_id, ordinal FROM fcts WHERE predicate = 'CALLS' AND subject_id IN (SELECT object_id FROM one) AND subject_id NOT IN (SELECT entity_id FROM ents WHERE label = '{ONE}'))
SELECT depth, fact_id FROM (SELECT 1 AS depth, fact_id, ordinal FROM one UNION ALL SELECT 2, fact_id, ordinal FROM two) ORDER BY depth, ordinal LIMIT 500""",
    "g_reverse_impact": f"""{SNAP}, roots AS (SELECT entity_id FROM ents WHERE label = '{ONE}.__init__'), ends AS (SELECT entity_id FROM ents WHERE label IN ('{ONE}.__init__', '{ONE}'))
SELECT DISTINCT 1 AS depth, a.label, coalesce(a.symbol_kind IN ('function', 'method', 'class'), false) AS affected, a.entity_id FROM fcts f JOIN ents a ON a.entity_id = f.subject_id
WHERE f.predicate = 'CALLS' AND f.object_id IN (SELECT entity_id FROM ends) AND f.subject_id NOT IN (SELECT entity_id FROM roots)""",
    "g_evidence_for_call": f"{SNAP} SELECT 'v:' || fact_id AS evidence_id, fact_id AS target_id FROM joined WHERE predicate = 'CALLS' AND subject_label = '{ONE}' ORDER BY ordinal LIMIT 50",
    "g_modules_importing": f"{SNAP} SELECT fact_id, category FROM joined WHERE predicate = 'IMPORTS' AND lower(object_label) = 'nation_5' ORDER BY ordinal LIMIT 500",
    "g_who_imports": f"""{SNAP} SELECT split_part(subject_label, '.', 1) AS prefix, count(*) AS n FROM (SELECT subject_label FROM joined WHERE predicate = 'IMPORTS' AND lower(object_label) = 'nation_5'
ORDER BY subject_label, ordinal LIMIT 500) GROUP BY 1""",
    "g_dependency_info": f"{SNAP} SELECT object_label AS name, category, fact_id FROM joined WHERE predicate = 'IMPORTS' AND lower(object_label) = 'nation_5' ORDER BY ordinal DESC LIMIT 1",
    "g_top_dependencies": f"{SNAP} SELECT object_label, count(*) AS n FROM joined WHERE predicate = 'IMPORTS' AND {_CANON} AND category NOT IN ('stdlib', 'unknown') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25",
    "g_top_internal": f"{SNAP} SELECT object_label, count(DISTINCT subject_label) AS importers FROM joined WHERE predicate = 'IMPORTS' AND {_CANON} AND category = 'internal_module' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25",
    "g_top_fan_in": f"{SNAP} SELECT object_label, count(DISTINCT subject_label) AS callers FROM joined WHERE predicate = 'CALLS' AND {_CANON} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25",
    "g_importing_both": f"""{SNAP} SELECT subject_label, count(*) FILTER (object_label = 'nation_5') AS first_facts, count(*) FILTER (object_label = 'nation_12') AS second_facts FROM joined
WHERE predicate = 'IMPORTS' GROUP BY 1 HAVING count(*) FILTER (object_label = 'nation_5') > 0 AND count(*) FILTER (object_label = 'nation_12') > 0 ORDER BY 1 LIMIT 500""",
    "g_cross_repo_links": f"{SNAP} SELECT fact_id, subject_label, object_label FROM joined WHERE predicate = 'RESOLVES_TO_REPO' ORDER BY 2, 3 LIMIT 100",
    "g_repo_dependencies": f"{SNAP} SELECT fact_id, subject_label FROM joined WHERE predicate = 'RESOLVES_TO_REPO' AND consumer_repo = 'org/r1' ORDER BY ordinal LIMIT 100",
    "g_domain_references": f"""{SNAP}, hit AS (SELECT entity_id FROM ents WHERE kind = 'Domain' AND contains(label, 'nation_1')), one AS (SELECT * FROM joined WHERE subject_id IN (FROM hit) OR object_id IN (FROM hit)),
env AS (SELECT subject_id AS id FROM one WHERE subject_kind = 'EnvVar') SELECT fact_id, predicate FROM joined WHERE fact_id IN (SELECT fact_id FROM one) OR subject_id IN (FROM env) OR object_id IN (FROM env) ORDER BY ordinal LIMIT 500""",
    "g_endpoints": f"{SNAP} SELECT predicate, method, path AS route, subject_label FROM joined WHERE object_kind = 'Endpoint' AND contains(path, '/api/b') ORDER BY path, method, predicate, ordinal LIMIT 500",
    "g_event_channels": f"""{SNAP} SELECT CASE WHEN predicate IN ('PRODUCES_EVENT', 'CONSUMES_EVENT') AND canonical_status = 'canonical' AND object_status = 'canonical' THEN 'known_linked' ELSE 'candidate' END AS linkage,
predicate, subject_label, object_label FROM joined WHERE object_kind = 'EventChannel' AND contains(object_label, 'a') ORDER BY linkage DESC, object_label, predicate, ordinal LIMIT 500""",
    "g_deploy_mappings": f"""{SNAP} SELECT CASE WHEN predicate = 'DEPLOYS_VIA_CONFIG' AND canonical_status = 'canonical' THEN 'known_linked' ELSE 'unlinked' END AS linkage, predicate, subject_label, object_label
FROM joined WHERE predicate IN ('DEPLOYS_VIA_CONFIG', 'ROUTES_DOMAIN_TO_DEPLOY') AND contains(object_label, 'a') ORDER BY object_label, predicate, ordinal LIMIT 500""",
    "g_reconcile": f"""{SNAP}, l AS (SELECT DISTINCT {_SHAPE} AS key FROM joined WHERE predicate = 'DOCUMENTS_ENDPOINT'), r AS (SELECT DISTINCT {_SHAPE} AS key FROM joined WHERE predicate = 'EXPOSES_ENDPOINT')
SELECT CASE WHEN l.key IS NULL THEN 'right_only' WHEN r.key IS NULL THEN 'left_only' ELSE 'matched' END AS side, count(*) AS n FROM l FULL JOIN r ON l.key = r.key GROUP BY 1""",
    "g_summary": f"""{SNAP} SELECT 'entities' AS section, kind AS name, count(*) AS n FROM ents GROUP BY 2 UNION ALL SELECT 'facts', predicate, count(*) FROM fcts GROUP BY 2
UNION ALL SELECT 'coverage', state, count(*) FROM cov GROUP BY 2""",
    "g_coverage_gaps": f"{SNAP} SELECT coverage_id, predicate, state FROM cov WHERE state <> 'instrumented' ORDER BY predicate, state, coverage_id LIMIT 200",
    "g_service_brief": f"""{SNAP}, hit AS (SELECT entity_id FROM ents WHERE kind = 'Service' AND contains(label, 'svc-99'))
SELECT predicate, count(*) AS n FROM fcts WHERE subject_id IN (FROM hit) AND (SELECT count(*) FROM hit) = 1 GROUP BY 1""",
    "g_planning_context": f"""{SNAP}, hit AS (SELECT entity_id FROM ents WHERE label = 'nation_7.example') SELECT predicate, CASE WHEN subject_id IN (FROM hit) THEN 'out' ELSE 'in' END AS direction, count(*) AS n
FROM fcts WHERE subject_id IN (FROM hit) OR object_id IN (FROM hit) GROUP BY 1, 2""",
    "g_runtime_map": f"""{SNAP} SELECT subject_label AS service, count(*) FILTER (predicate = 'EXPOSES_ENDPOINT') AS endpoints, count(*) FILTER (predicate = 'PRODUCES_EVENT') AS produced,
count(*) FILTER (predicate = 'CONSUMES_EVENT') AS consumed, count(*) FILTER (predicate = 'DEPLOYS_VIA_CONFIG') AS deploys FROM joined
WHERE predicate IN ('EXPOSES_ENDPOINT', 'PRODUCES_EVENT', 'CONSUMES_EVENT', 'DEPLOYS_VIA_CONFIG') GROUP BY 1 ORDER BY 1 LIMIT 500""",
    "g_unlinked_routes": f"""{SNAP} SELECT DISTINCT subject_label AS domain, object_label AS target FROM joined WHERE predicate = 'ROUTES_DOMAIN_TO_DEPLOY'
AND object_id NOT IN (SELECT object_id FROM fcts WHERE predicate = 'DEPLOYS_VIA_CONFIG') ORDER BY 1, 2 LIMIT 500""",
    "g_review_symbols": f"""{SNAP}, r(path, a, b) AS (VALUES ('{FILE}', 22, 23), ('{FILE}', 45, 46), ('src/pkg0/m0.py', 70, 130)),
met AS (SELECT s.entity_id, s.label, s.file, s.line_start, s.line_end, r.a, r.b FROM syms s JOIN r ON r.path = s.file AND s.line_start <= r.b AND r.a <= s.line_end)
SELECT DISTINCT label, file AS path, (line_start <= a AND b <= line_end) AS enclosing, entity_id FROM met m WHERE NOT EXISTS (SELECT 1 FROM met i WHERE i.file = m.file AND i.a = m.a AND i.b = m.b
AND m.line_start <= i.line_start AND i.line_end <= m.line_end AND m.line_end - m.line_start > i.line_end - i.line_start)""",
}
ORACLES["g_reverse_impact"] = f"SELECT depth, label, affected FROM ({ORACLES['g_reverse_impact']}) ORDER BY depth, label LIMIT 500"
ORACLES["g_review_symbols"] = f"SELECT label, path, enclosing FROM ({ORACLES['g_review_symbols']}) ORDER BY path, label LIMIT 500"
