"""Queries on evidence, coverage metrics, rankings, budgets and evaluation arms."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratagraph.operators import aggregate, joins, metrics, ranking

from .projections import CALLS, COVERAGE, EVIDENCE, IMPORTS, LINKS, PROVIDERS, calls, coverage, evidence, imports, links, provider_candidates, table

CUTOFF = "1999-01-01"
BUDGET = 40_000


def _order():
    return [F.desc("quantity"), F.desc("priority"), F.col("fact"), F.col("ordinal"), F.col("source_system")]


def rank_rows_topk(spark, sf_dir):
    """The five-level rank: match, class, fact, place, system."""
    rows = evidence(spark, sf_dir).withColumn("priority", aggregate.priority("derivation_class", aggregate.RANK_ORDER)).drop("ingested_at")
    return ranking.ranked(rows.distinct(), *_order(), limit=200)


def diverse_topk(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return ranking.diverse(docs, "source", 10, F.desc("n_chars"), F.col("doc_id"))


def per_kind_cap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return ranking.capped(docs, ["source", "lang"], 2, F.desc("n_chars"), F.col("doc_id")).select("doc_id", "lang", "source", F.col("place").cast("long").alias("place"))


def round_robin(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return ranking.round_robin(docs, "source", 60, F.col("doc_id"))


def budget_prefix(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.greatest("n_chars", F.lit(1)).alias("n_chars"))
    return ranking.within_budget(docs, "n_chars", BUDGET, F.col("doc_id"))


def metric_freshness(spark, sf_dir):
    return metrics.freshness(evidence(spark, sf_dir), "ingested_at", F.lit(CUTOFF).cast("timestamp_ntz"))


def metric_grounding(spark, sf_dir):
    facts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("fact"))
    return metrics.grounding(facts, evidence(spark, sf_dir), "fact", F.col("quantity") >= 45)


def metric_trust_mix(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    state = F.when(F.col("p_size") <= 25, "canonical").when(F.col("p_size") <= 40, "candidate").otherwise("demoted")
    facts = part.select(F.col("p_partkey").alias("fact"), state.alias("status"))
    seen = evidence(spark, sf_dir).where("quantity >= 30")
    return metrics.trust_mix(facts, seen, "fact")


def metric_useful_edge(spark, sf_dir):
    anchors = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("node"))
    return metrics.useful_edge(anchors, calls(spark, sf_dir).where("dst > src * 2"), "node", ["src", "dst"])


def metric_meta_coverage(spark, sf_dir):
    """The share of expected coverage states and predicates that are seen."""
    names = ["CALLS", "IMPORTS", "EXPOSES", "instrumented", "stale", "DEPLOYS_VIA_CONFIG"]
    expected = spark.createDataFrame([(n,) for n in names], "name string")
    seen = coverage(spark, sf_dir).select(F.col("state").alias("name")).union(links(spark, sf_dir).select("side"))
    return metrics.opportunity(expected, seen, "name")


def metric_identity_health(spark, sf_dir):
    from stratagraph.functions import columns as C

    urns = table(spark, sf_dir, "part").select(
        F.when(F.col("p_size") % 7 == 0, C.stable_hash("ent_", "p_partkey")).otherwise(F.concat(F.lit("urn:part:"), F.col("p_partkey").cast("string"))).alias("urn")
    )
    return metrics.share(urns, ~F.col("urn").rlike("[0-9a-f]{24}$"))


def metric_cross_repo_linkage(spark, sf_dir):
    n = provider_candidates(spark, sf_dir).groupBy("consumer").agg(F.count("*").alias("n"))
    return metrics.share(n, F.col("n") == 1)


def metric_extractor_opportunity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"))
    return metrics.opportunity(docs, coverage(spark, sf_dir).where("state <> 'stale'"), "doc")


def metric_silent_gap(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"))
    states = coverage(spark, sf_dir)
    return metrics.silent_gap(docs, "doc", states.where("state = 'instrumented'"), states.where("state = 'uninstrumented'"))


def _cells(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "source", "lang", "n_chars")
    return docs.join(coverage(spark, sf_dir), "doc", "left")


def metric_inventory(spark, sf_dir):
    """By cell: covered documents over an expected ten, one at most."""
    return _cells(spark, sf_dir).groupBy("source", "lang").agg(F.least(F.count("state") / 10, F.lit(1.0)).alias("value"))


def metric_dimension_classification(spark, sf_dir):
    return metrics.share(_cells(spark, sf_dir), F.col("state").isNotNull(), by=["source", "lang"])


def _cell_metrics(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    part = lambda test: metrics.ratio(F.count_if(F.coalesce(test, F.lit(False))).cast("double"), F.count("*").cast("double"))
    wide = cells.groupBy("source", "lang").agg(
        part(F.col("state").isNotNull()).alias("classified"), part(F.col("state") == "instrumented").alias("instrumented"), part(F.col("n_chars") > 200).alias("sized")
    )
    return wide.unpivot(["source", "lang"], ["classified", "instrumented", "sized"], "metric", "value")


def fleet_worst_groups(spark, sf_dir):
    cells = metrics.geometric_mean(_cell_metrics(spark, sf_dir), ["source", "lang"], "value")
    means = cells.groupBy("source").agg(F.round(F.avg("score"), 9).alias("score"), F.count_if(F.col("score") == 0).alias("zero_cells"))
    return means.orderBy("score", "source").limit(8)


def worst_metrics(spark, sf_dir):
    rows = _cell_metrics(spark, sf_dir)
    return rows.groupBy("metric").agg(F.round(F.avg(1 - F.col("value")), 9).alias("badness"), F.count_if(F.col("value") == 0).alias("zero_cells"))


def coverage_gaps(spark, sf_dir):
    return coverage(spark, sf_dir).where("state <> 'instrumented'").orderBy("state", "doc").limit(100)


def coverage_state_counts(spark, sf_dir):
    return coverage(spark, sf_dir).groupBy("state").agg(F.count("*").alias("n"))


def _by_lang(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    known = docs.join(table(spark, sf_dir, "labels").select("doc_id").distinct(), "doc_id", "left_semi")
    return docs, known


def metrics_delta(spark, sf_dir):
    docs, known = _by_lang(spark, sf_dir)
    count = lambda df: df.groupBy("lang").agg(F.count("*").alias("n"))
    return joins.drift(count(docs), count(known), "lang", "n")


def baseline_drift(spark, sf_dir):
    docs, known = _by_lang(spark, sf_dir)
    count = lambda df: df.groupBy("source").agg(F.count("*").alias("n"))
    return joins.drift(count(docs.where("lang = 'en'")), count(known), "source", "n").where("change <> 0")


def _arms(spark, sf_dir):
    """(conv, pair, arm, chars, words): user and assistant rows of a conversation, paired in order."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "conversations").where("role <> 'system'")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text")) - 1
    arm = F.when(F.col("place") % 2 == 0, "off").otherwise("on")
    return rows.withColumn("place", place).select(
        F.col("conv_id").alias("conv"), F.floor(F.col("place") / 2).alias("pair"), arm.alias("arm"),
        F.char_length("text").cast("long").alias("chars"), F.size(F.split("text", " ")).cast("long").alias("words"),
    )


def paired_deltas(spark, sf_dir):
    return joins.paired(_arms(spark, sf_dir), ["conv", "pair"], "arm", "off", "on", ["chars", "words"])


def phase_aggregates(spark, sf_dir):
    return paired_deltas(spark, sf_dir).groupBy("pair").agg(
        F.count("*").alias("n"), F.avg("chars_saved").alias("chars_saved"), F.avg("words_saved").alias("words_saved")
    )


def rubric_counts(spark, sf_dir):
    """Winners by measure: the arm with fewer, or a tie."""
    rows = paired_deltas(spark, sf_dir).unpivot(["conv", "pair"], ["chars_saved", "words_saved"], "aspect", "saved")
    winner = F.when(F.col("saved") > 0, "on").when(F.col("saved") < 0, "off").otherwise("tie")
    return rows.groupBy("aspect", winner.alias("winner")).agg(F.count("*").alias("n"))


def config_scan_split(spark, sf_dir):
    """Texts within the size cap are scanned; longer ones are reported as coverage."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return docs.select("doc_id", F.when(F.col("n_chars") <= 2000, "scanned").otherwise("too_large").alias("state"))


def unsupported_languages(spark, sf_dir):
    """Files and characters by language that no plugin reads."""
    docs = table(spark, sf_dir, "documents").where(~F.col("lang").isin("en", "de"))
    return docs.groupBy("lang").agg(F.count("*").alias("files"), F.sum("n_chars").alias("chars"))


def import_categories(spark, sf_dir):
    return imports(spark, sf_dir).groupBy("package").pivot("category", ["third_party", "internal_module", "unknown"]).agg(F.count(F.lit(1))).na.fill(0)


QUERIES = {
    f.__name__: f
    for f in (
        rank_rows_topk, diverse_topk, per_kind_cap, round_robin, budget_prefix, metric_freshness, metric_grounding, metric_trust_mix, metric_useful_edge,
        metric_meta_coverage, metric_identity_health, metric_cross_repo_linkage, metric_extractor_opportunity, metric_silent_gap, metric_inventory,
        metric_dimension_classification, fleet_worst_groups, worst_metrics, coverage_gaps, coverage_state_counts, metrics_delta,
        baseline_drift, paired_deltas, phase_aggregates, rubric_counts, config_scan_split, unsupported_languages, import_categories,
    )
}

_RANK = " ".join(f"WHEN '{c}' THEN {len(aggregate.RANK_ORDER) - i}" for i, c in enumerate(aggregate.RANK_ORDER))
_TRUST = " ".join(f"WHEN '{c}' THEN {w}" for c, w in metrics.DERIVATION_WEIGHTS.items())
_CELLS = f"""WITH {COVERAGE}, cells AS (SELECT doc_id AS doc, source, lang, n_chars, state FROM documents LEFT JOIN coverage ON doc = doc_id),
wide AS (SELECT source, lang, count(state) / count(*) AS classified, count(*) FILTER (state = 'instrumented') / count(*) AS instrumented,
  count(*) FILTER (n_chars > 200) / count(*) AS sized FROM cells GROUP BY 1, 2),
long AS (UNPIVOT wide ON classified, instrumented, sized INTO NAME metric VALUE value)"""
_SCORES = _CELLS + """, scores AS (SELECT source, lang, CASE WHEN min(value) <= 0 THEN 0.0 ELSE exp(avg(ln(CASE WHEN value > 0 THEN value END))) END AS score FROM long GROUP BY 1, 2)"""
_PAIRS = """WITH a AS (
  SELECT conv_id AS conv, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS place, length(text) AS chars, len(string_split(text, ' ')) AS words
  FROM conversations WHERE role <> 'system'),
d AS (SELECT x.conv, x.place // 2 AS pair, x.chars - y.chars AS chars_saved, x.words - y.words AS words_saved FROM a x JOIN a y
  ON x.conv = y.conv AND x.place % 2 = 0 AND y.place = x.place + 1)"""

ORACLES = {
    "rank_rows_topk": f"""WITH {EVIDENCE}, r AS (SELECT DISTINCT ordinal, fact, derivation_class, source_system, quantity,
  (CASE derivation_class {_RANK} ELSE 0 END)::INT AS priority FROM evidence)
SELECT *, row_number() OVER (ORDER BY quantity DESC, priority DESC, fact, ordinal, source_system) AS rank FROM r ORDER BY rank LIMIT 200""",
    "diverse_topk": """SELECT doc_id, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) = 1
ORDER BY n_chars DESC, doc_id LIMIT 10""",
    "per_kind_cap": """SELECT doc_id, lang, source, row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) AS place FROM documents
QUALIFY row_number() OVER (PARTITION BY source, lang ORDER BY n_chars DESC, doc_id) <= 2""",
    "round_robin": """SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS round FROM documents ORDER BY round, source LIMIT 60""",
    "budget_prefix": f"""SELECT * FROM (SELECT doc_id, greatest(n_chars, 1) AS n_chars, sum(greatest(n_chars, 1)) OVER (ORDER BY doc_id)::BIGINT AS used FROM documents) WHERE used <= {BUDGET}""",
    "metric_freshness": f"SELECT avg((l_shipdate >= TIMESTAMP '{CUTOFF}')::INT) AS value FROM lineitem WHERE l_shipdate IS NOT NULL",
    "metric_grounding": "SELECT avg((p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity >= 45))::INT) AS value FROM (SELECT DISTINCT p_partkey FROM part)",
    "metric_trust_mix": f"""WITH {EVIDENCE}, b AS (SELECT fact, max(CASE derivation_class {_TRUST} ELSE 0 END) AS best FROM evidence WHERE quantity >= 30 GROUP BY 1)
SELECT avg(CASE WHEN p_size <= 25 THEN 1.0::DOUBLE WHEN p_size <= 40 THEN 0.5 ELSE 0.1 END * coalesce(best, 0)::DOUBLE) AS value FROM part LEFT JOIN b ON fact = p_partkey""",
    "metric_useful_edge": f"""WITH {CALLS}, t AS (SELECT src AS n FROM calls WHERE dst > src * 2 UNION SELECT dst FROM calls WHERE dst > src * 2)
SELECT avg((p_partkey IN (SELECT n FROM t))::INT) AS value FROM part""",
    "metric_meta_coverage": f"""WITH {COVERAGE}, {LINKS}, e AS (SELECT unnest(['CALLS', 'IMPORTS', 'EXPOSES', 'instrumented', 'stale', 'DEPLOYS_VIA_CONFIG']) AS name)
SELECT avg((name IN (SELECT state FROM coverage UNION SELECT side FROM links))::INT) AS value FROM e""",
    "metric_identity_health": "SELECT avg((p_size % 7 <> 0)::INT) AS value FROM part",
    "metric_cross_repo_linkage": f"WITH {PROVIDERS} SELECT avg((n = 1)::INT) AS value FROM (SELECT consumer, count(*) AS n FROM providers GROUP BY 1)",
    "metric_extractor_opportunity": f"WITH {COVERAGE} SELECT avg((doc_id IN (SELECT doc FROM coverage WHERE state <> 'stale'))::INT) AS value FROM documents",
    "metric_silent_gap": f"WITH {COVERAGE} SELECT avg((doc_id NOT IN (SELECT doc FROM coverage WHERE state IN ('instrumented', 'uninstrumented')))::INT) AS value FROM documents",
    "metric_inventory": f"{_CELLS} SELECT source, lang, least(count(state) / 10, 1.0) AS value FROM cells GROUP BY 1, 2",
    "metric_dimension_classification": f"{_CELLS} SELECT source, lang, count(state) / count(*) AS value FROM cells GROUP BY 1, 2",
    "fleet_worst_groups": f"{_SCORES} SELECT source, round(avg(score), 9) AS score, count(*) FILTER (score = 0) AS zero_cells FROM scores GROUP BY 1 ORDER BY 2, 1 LIMIT 8",
    "worst_metrics": f"{_CELLS} SELECT metric, round(avg(1 - value), 9) AS badness, count(*) FILTER (value = 0) AS zero_cells FROM long GROUP BY 1",
    "coverage_gaps": f"WITH {COVERAGE} SELECT * FROM coverage WHERE state <> 'instrumented' ORDER BY state, doc LIMIT 100",
    "coverage_state_counts": f"WITH {COVERAGE} SELECT state, count(*) AS n FROM coverage GROUP BY 1",
    "metrics_delta": """WITH b AS (SELECT lang, count(*) AS n FROM documents GROUP BY 1), a AS (SELECT lang, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1)
SELECT coalesce(b.lang, a.lang) AS lang, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after, coalesce(a.n, 0) - coalesce(b.n, 0) AS change FROM b FULL JOIN a ON b.lang = a.lang""",
    "baseline_drift": """WITH b AS (SELECT source, count(*) AS n FROM documents WHERE lang = 'en' GROUP BY 1), a AS (SELECT source, count(*) AS n FROM documents WHERE doc_id IN (SELECT doc_id FROM labels) GROUP BY 1)
SELECT * FROM (SELECT coalesce(b.source, a.source) AS source, coalesce(b.n, 0) AS before, coalesce(a.n, 0) AS after, coalesce(a.n, 0) - coalesce(b.n, 0) AS change
FROM b FULL JOIN a ON b.source = a.source) WHERE change <> 0""",
    "paired_deltas": f"{_PAIRS} SELECT * FROM d",
    "phase_aggregates": f"{_PAIRS} SELECT pair, count(*) AS n, avg(chars_saved) AS chars_saved, avg(words_saved) AS words_saved FROM d GROUP BY 1",
    "rubric_counts": f"""{_PAIRS}, u AS (UNPIVOT d ON chars_saved, words_saved INTO NAME aspect VALUE saved)
SELECT aspect, CASE WHEN saved > 0 THEN 'on' WHEN saved < 0 THEN 'off' ELSE 'tie' END AS winner, count(*) AS n FROM u GROUP BY 1, 2""",
    "config_scan_split": "SELECT doc_id, CASE WHEN n_chars <= 2000 THEN 'scanned' ELSE 'too_large' END AS state FROM documents",
    "unsupported_languages": "SELECT lang, count(*) AS files, sum(n_chars)::BIGINT AS chars FROM documents WHERE lang NOT IN ('en', 'de') GROUP BY 1",
    "import_categories": f"""WITH {IMPORTS} SELECT package, count(*) FILTER (category = 'third_party') AS third_party, count(*) FILTER (category = 'internal_module') AS internal_module,
  count(*) FILTER (category = 'unknown') AS unknown FROM imports GROUP BY 1""",
}
