"""Queries on symbols, calls and imports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.functions import columns as C
from stratagraph.operators import aggregate, joins, resolve, traversal
from stratagraph.operators.lineage import cut

from .projections import CALLS, EVIDENCE, IMPORTS, PROVIDERS, calls, evidence, imports, provider_candidates, table

PART, LIMIT = 10, 50


def _node(spark: SparkSession, *keys: int) -> DataFrame:
    return spark.createDataFrame([(k,) for k in keys], "node long")


def kg_summary_kinds(spark, sf_dir):
    kinds = {"CodeSymbol": "part", "Service": "customer", "ExternalPackage": "supplier", "CodeModule": "orders"}
    rows = [table(spark, sf_dir, t).select(F.lit(k).alias("kind")) for k, t in kinds.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.union(r)
    return out.groupBy("kind").agg(F.count("*").alias("n"))


def kg_summary_predicates(spark, sf_dir):
    rows = calls(spark, sf_dir).select(F.lit("CALLS").alias("predicate")).union(imports(spark, sf_dir).select(F.lit("IMPORTS")))
    rows = rows.union(provider_candidates(spark, sf_dir).select(F.lit("RESOLVES_TO_REPO")))
    return rows.groupBy("predicate").agg(F.count("*").alias("n"))


def entity_ids(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    return parts.select("p_partkey", C.stable_hash("ent_", F.lit("CodeSymbol"), "p_name", "p_partkey").alias("entity_id"))


def display_labels(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.lit("CodeSymbol").alias("kind"), F.concat("p_brand", F.lit("."), "p_name").alias("label"))
    pages = table(spark, sf_dir, "pages").select(F.lit("Endpoint").alias("kind"), F.concat_ws(" ", C.host("url"), F.lit("GET"), C.url_path("url")).alias("label"))
    nations = table(spark, sf_dir, "nation").select(F.lit("Domain").alias("kind"), F.lower("n_name").alias("label"))
    return parts.union(pages).union(nations).groupBy("kind", "label").agg(F.count("*").alias("n"))


def find_callers(spark, sf_dir):
    found = traversal.backward(calls(spark, sf_dir))
    found = joins.touching(found, _node(spark, PART), "src").orderBy("ordinal", "dst").limit(LIMIT)
    return found.select(F.col("dst").alias("caller"), "ordinal")


def find_callees(spark, sf_dir):
    found = joins.touching(calls(spark, sf_dir), _node(spark, PART), "src").orderBy("ordinal", "dst").limit(LIMIT)
    return found.select(F.col("dst").alias("callee"), "ordinal")


def call_ends(spark, sf_dir):
    parts = table(spark, sf_dir, "part")
    edges = joins.touching(calls(spark, sf_dir), _node(spark, PART), "src")
    return joins.with_ends(edges, parts, "p_partkey", "p_name").select("src", "dst", "src_label", "dst_label", "ordinal")


def _symbols(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_name").alias("name"), F.concat_ws("#", "p_name", F.col("p_partkey").cast("string")).alias("qualified"))


def _first_name(spark, sf_dir):
    return table(spark, sf_dir, "part").agg(F.min("p_name")).first()[0] or ""  # one value


def resolve_symbol_tiers(spark, sf_dir):
    return resolve.best_tier(_symbols(spark, sf_dir), _first_name(spark, sf_dir))


def symbols_in_file(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_linenumber", "l_partkey", F.concat(F.lit("./orders/"), F.col("l_orderkey").cast("string")).alias("path"))
    return resolve.in_file(lines, C.normal_path("path"), "orders/7", ("l_linenumber", "l_partkey")).select("l_linenumber", "l_partkey")


def evidence_for_call(spark, sf_dir):
    """Evidence of the fixed part's calls, in the first hundred orders of coordinates."""
    edges = joins.touching(calls(spark, sf_dir), _node(spark, PART), "src")
    seen = evidence(spark, sf_dir).select(F.col("ordinal").alias("line"), F.col("fact"), "derivation_class")
    found = edges.join(seen, (F.col("fact") == F.col("src")) & F.col("line").between(F.col("ordinal") - 500, F.col("ordinal") + 500))
    return found.select("src", "dst", "ordinal", "line", "derivation_class")


def _edges(spark, sf_dir):
    """The calls, joined once: each step of a walk reads them again."""
    return cut(calls(spark, sf_dir))


def blast_radius(spark, sf_dir):
    edges = traversal.walked_edges(_edges(spark, sf_dir), _node(spark, PART), 2)
    return edges.orderBy("depth", "ordinal", "src", "dst").limit(2000).select("src", "dst", "depth", "ordinal")


def transitive_callers(spark, sf_dir):
    return traversal.reach(traversal.backward(_edges(spark, sf_dir)), _node(spark, PART, PART + 1), 2).where("depth > 0")


def reverse_impact_tiers(spark, sf_dir):
    out = traversal.impact_tiers(_edges(spark, sf_dir), _node(spark, PART), 3)
    return out.select("depth", "affected", "no_incoming")


def dependency_paths(spark, sf_dir):
    """Region to nation to supplier to customer of that nation: typed edges over the hierarchy."""
    nations = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("n"), "n_nationkey", "n_regionkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    edges = (
        nations.select(F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("src"), F.col("n").alias("dst"))
        .union(suppliers.select(n("s_nationkey"), F.concat(F.lit("s"), F.col("s_suppkey").cast("string"))))
        .union(suppliers.select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")), n("s_nationkey")))
        .union(customers.select(n("c_nationkey"), F.concat(F.lit("c"), F.col("c_custkey").cast("string"))))
    )
    targets = customers.select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node"))
    root = spark.createDataFrame([("r1",)], "node string")
    return traversal.simple_paths(edges, root, targets, 4).select(F.array_join("path", ">").alias("path"), "steps")


def modules_importing(spark, sf_dir):
    return imports(spark, sf_dir).where("package LIKE 'Brand#11/%'").orderBy("module", "package", "category").limit(LIMIT)


def top_dependencies(spark, sf_dir):
    return aggregate.top_counts(imports(spark, sf_dir).where("category <> 'unknown'"), "package", 20)


def dependency_info(spark, sf_dir):
    return aggregate.last_wins(imports(spark, sf_dir), ["package"], F.struct("module", "ordinal", "category"), "module", "category")


def who_imports_grouped(spark, sf_dir):
    some = imports(spark, sf_dir).where("category = 'third_party'").orderBy("module", "package").limit(300)
    return some.groupBy(F.floor(F.col("module") / 10).alias("prefix")).agg(F.count("*").alias("importers"))


def top_internal_dependencies(spark, sf_dir):
    return aggregate.top_counts(imports(spark, sf_dir).where("category = 'internal_module'"), "package", 20, distinct="module", into="importers")


def top_fan_in_symbols(spark, sf_dir):
    return aggregate.top_counts(calls(spark, sf_dir), "dst", 25, distinct="src", into="callers")


def _two_packages(spark, sf_dir):
    row = table(spark, sf_dir, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("p")).agg(F.min("p"), F.max("p")).first()
    return row[0] or "", row[1] or ""


def modules_importing_both(spark, sf_dir):
    return joins.both(imports(spark, sf_dir), "module", "package", *_two_packages(spark, sf_dir))


def import_target_ambiguity(spark, sf_dir):
    names = table(spark, sf_dir, "part").select(F.lower("p_name").alias("alias"), F.concat_ws("/", "p_brand", "p_type").alias("target"))
    return resolve.target_ambiguity(names, "alias", "target")


def evidence_summary(spark, sf_dir):
    return aggregate.evidence_summary(evidence(spark, sf_dir), "fact", "ordinal")


def dedupe_first_wins(spark, sf_dir):
    seen = evidence(spark, sf_dir).select("fact", "source_system", "ordinal", "derivation_class", "quantity")
    return aggregate.first_wins(seen, ["fact", "source_system"], F.struct("ordinal", "derivation_class", "quantity"))


def cross_repo_links(spark, sf_dir):
    return resolve.unique_providers(provider_candidates(spark, sf_dir), "consumer", "provider").where("providers = 1").select("consumer", "provider")


def repo_dependencies(spark, sf_dir):
    links = cross_repo_links(spark, sf_dir)
    return links.groupBy("provider").agg(F.count("*").alias("consumers"), F.min("consumer").alias("first_consumer"))


def link_unique_provider(spark, sf_dir):
    links = cross_repo_links(spark, sf_dir)
    return links.withColumn("fact_id", C.stable_hash("fact_", F.lit("RESOLVES_TO_REPO"), "consumer", "provider"))


def link_ambiguous(spark, sf_dir):
    return resolve.unique_providers(provider_candidates(spark, sf_dir), "consumer", "provider").where("providers > 1").select("consumer", "providers")


QUERIES = {
    f.__name__: f
    for f in (
        kg_summary_kinds, kg_summary_predicates, entity_ids, display_labels, find_callers, find_callees, call_ends, resolve_symbol_tiers,
        symbols_in_file, evidence_for_call, blast_radius, transitive_callers, reverse_impact_tiers, dependency_paths, modules_importing,
        top_dependencies, dependency_info, who_imports_grouped, top_internal_dependencies, top_fan_in_symbols, modules_importing_both,
        import_target_ambiguity, evidence_summary, dedupe_first_wins, cross_repo_links, repo_dependencies, link_unique_provider,
        link_ambiguous,
    )
}

from .projections import HOST, PATH  # noqa: E402

_UNIQUE = "one AS (SELECT consumer, min(provider) AS provider, count(*) AS providers FROM providers GROUP BY 1)"

ORACLES = {
    "kg_summary_kinds": """SELECT 'CodeSymbol' AS kind, count(*) AS n FROM part UNION ALL SELECT 'Service', count(*) FROM customer
UNION ALL SELECT 'ExternalPackage', count(*) FROM supplier UNION ALL SELECT 'CodeModule', count(*) FROM orders""",
    "kg_summary_predicates": f"""WITH {CALLS}, {IMPORTS}, {PROVIDERS} SELECT 'CALLS' AS predicate, count(*) AS n FROM calls
UNION ALL SELECT 'IMPORTS', count(*) FROM imports UNION ALL SELECT 'RESOLVES_TO_REPO', count(*) FROM providers""",
    "entity_ids": "SELECT p_partkey, 'ent_' || substr(sha256('CodeSymbol|' || p_name || '|' || p_partkey), 1, 24) AS entity_id FROM part",
    "display_labels": f"""SELECT kind, label, count(*) AS n FROM (
  SELECT 'CodeSymbol' AS kind, p_brand || '.' || p_name AS label FROM part
  UNION ALL SELECT 'Endpoint', {HOST.format(x="url")} || ' GET ' || {PATH.format(x="url")} FROM pages
  UNION ALL SELECT 'Domain', lower(n_name) FROM nation) GROUP BY 1, 2""",
    "find_callers": f"WITH {CALLS} SELECT src AS caller, ordinal FROM calls WHERE dst = {PART} ORDER BY ordinal, src LIMIT {LIMIT}",
    "find_callees": f"WITH {CALLS} SELECT dst AS callee, ordinal FROM calls WHERE src = {PART} ORDER BY ordinal, dst LIMIT {LIMIT}",
    "call_ends": f"""WITH {CALLS} SELECT src, dst, a.p_name AS src_label, b.p_name AS dst_label, ordinal
FROM calls JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE src = {PART}""",
    "resolve_symbol_tiers": """WITH q AS (SELECT min(p_name) AS q FROM part), s AS (
  SELECT p_name AS name, p_name || '#' || p_partkey AS qualified,
    CASE WHEN p_name || '#' || p_partkey = q THEN 0 WHEN p_name = q THEN 1 WHEN contains(lower(p_name || '#' || p_partkey), lower(q)) THEN 2 END AS t FROM part, q
), k AS (SELECT * FROM s WHERE t = (SELECT min(t) FROM s))
SELECT name, qualified, count(*) OVER () AS matches, ['exact_qualified', 'exact_name', 'fuzzy'][t + 1] AS tier,
  CASE WHEN count(*) OVER () = 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution FROM k ORDER BY qualified LIMIT 100""",
    "symbols_in_file": "SELECT l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 7 ORDER BY 1, 2 LIMIT 100",
    "evidence_for_call": f"""WITH {CALLS}, {EVIDENCE} SELECT src, dst, c.ordinal, e.ordinal AS line, derivation_class
FROM calls c JOIN evidence e ON e.fact = src AND e.ordinal BETWEEN c.ordinal - 500 AND c.ordinal + 500 WHERE src = {PART}""",
    "blast_radius": f"""WITH RECURSIVE {CALLS}, walk(node, depth) AS (
  SELECT {PART}::BIGINT, 0 UNION SELECT dst, depth + 1 FROM walk JOIN calls ON src = node WHERE depth < 1
), nodes AS (SELECT node, min(depth) AS depth FROM walk GROUP BY 1)
SELECT src, dst, depth + 1 AS depth, ordinal FROM nodes JOIN calls ON src = node ORDER BY 3, 4, 1, 2 LIMIT 2000""",
    "transitive_callers": f"""WITH RECURSIVE {CALLS}, walk(node, depth) AS (
  SELECT * FROM (VALUES ({PART}::BIGINT, 0), ({PART + 1}, 0)) UNION SELECT src, depth + 1 FROM walk JOIN calls ON dst = node WHERE depth < 2)
SELECT node, min(depth) AS depth FROM walk GROUP BY 1 HAVING min(depth) > 0""",
    "reverse_impact_tiers": f"""WITH RECURSIVE {CALLS}, walk(node, depth) AS (
  SELECT {PART}::BIGINT, 0 UNION SELECT src, depth + 1 FROM walk JOIN calls ON dst = node WHERE depth < 3
), nodes AS (SELECT node, min(depth) AS depth FROM walk GROUP BY 1)
SELECT depth, count(*) AS affected, count(*) FILTER (node NOT IN (SELECT dst FROM calls)) AS no_incoming FROM nodes WHERE depth > 0 GROUP BY 1""",
    "dependency_paths": """WITH RECURSIVE edges AS (
  SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey FROM supplier UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer
), walk(path) AS (
  SELECT ['r1'] UNION SELECT list_append(path, dst) FROM walk JOIN edges ON src = path[-1]
  WHERE len(path) <= 4 AND NOT list_contains(path, dst) AND path[-1][1] <> 'c')
SELECT array_to_string(path, '>') AS path, len(path)::INT - 1 AS steps FROM walk WHERE path[-1][1] = 'c'""",
    "modules_importing": f"WITH {IMPORTS} SELECT * FROM imports WHERE package LIKE 'Brand#11/%' ORDER BY module, package, category LIMIT {LIMIT}",
    "top_dependencies": f"WITH {IMPORTS} SELECT package, count(*) AS n FROM imports WHERE category <> 'unknown' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "dependency_info": f"""WITH {IMPORTS} SELECT package, module, category FROM (
  SELECT *, row_number() OVER (PARTITION BY package ORDER BY module DESC, ordinal DESC, category DESC) AS r FROM imports) WHERE r = 1""",
    "who_imports_grouped": f"""WITH {IMPORTS} SELECT module // 10 AS prefix, count(*) AS importers
FROM (SELECT * FROM imports WHERE category = 'third_party' ORDER BY module, package LIMIT 300) GROUP BY 1""",
    "top_internal_dependencies": f"WITH {IMPORTS} SELECT package, count(DISTINCT module) AS importers FROM imports WHERE category = 'internal_module' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "top_fan_in_symbols": f"WITH {CALLS} SELECT dst, count(DISTINCT src) AS callers FROM calls GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25",
    "modules_importing_both": f"""WITH {IMPORTS}, p AS (SELECT min(p_brand || '/' || p_type) AS a, max(p_brand || '/' || p_type) AS b FROM part)
SELECT module, count(*) FILTER (package = a) AS first_facts, count(*) FILTER (package = b) AS second_facts FROM imports, p GROUP BY 1
HAVING count(*) FILTER (package = a) > 0 AND count(*) FILTER (package = b) > 0""",
    "import_target_ambiguity": """SELECT lower(p_name) AS alias, count(DISTINCT p_brand || '/' || p_type) AS targets,
  CASE WHEN count(DISTINCT p_brand || '/' || p_type) = 1 THEN 'resolved' ELSE 'ambiguous' END AS resolution FROM part GROUP BY 1""",
    "evidence_summary": f"""WITH {EVIDENCE}, p AS (SELECT *, CASE derivation_class WHEN 'authoritative_declared' THEN 5 WHEN 'runtime_observed' THEN 4
    WHEN 'deterministic_static' THEN 3 WHEN 'manual_override' THEN 2 WHEN 'inferred_llm' THEN 1 ELSE 0 END AS p FROM evidence)
SELECT fact, arg_max(derivation_class, p) AS strongest, count(DISTINCT source_system) AS systems, count(*) AS rows FROM p GROUP BY 1""",
    "dedupe_first_wins": f"""WITH {EVIDENCE} SELECT fact, source_system, ordinal, derivation_class, quantity FROM (
  SELECT *, row_number() OVER (PARTITION BY fact, source_system ORDER BY ordinal, derivation_class, quantity) AS r FROM evidence) WHERE r = 1""",
    "cross_repo_links": f"WITH {PROVIDERS}, {_UNIQUE} SELECT consumer, provider FROM one WHERE providers = 1",
    "repo_dependencies": f"WITH {PROVIDERS}, {_UNIQUE} SELECT provider, count(*) AS consumers, min(consumer) AS first_consumer FROM one WHERE providers = 1 GROUP BY 1",
    "link_unique_provider": f"""WITH {PROVIDERS}, {_UNIQUE} SELECT consumer, provider,
  'fact_' || substr(sha256('RESOLVES_TO_REPO|' || consumer || '|' || provider), 1, 24) AS fact_id FROM one WHERE providers = 1""",
    "link_ambiguous": f"WITH {PROVIDERS}, {_UNIQUE} SELECT consumer, providers FROM one WHERE providers > 1",
}
