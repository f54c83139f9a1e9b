"""Queries on event channels, endpoints, domains, contracts and spans."""

from __future__ import annotations

from pyspark.sql import functions as F

from stratagraph.functions import columns as C
from stratagraph.operators import aggregate, joins, ranking, resolve

from .projections import CHANNELS, HOST, LINKS, SPANS, channel_facts, links, ranges, spans, table

def _directed():
    return F.col("predicate").isin("PRODUCES", "CONSUMES")


def promotion_demoted(spark, sf_dir):
    channels, _ = aggregate.promotion(channel_facts(spark, sf_dir), "channel", _directed())
    return channels.where("status = 'candidate'").select("channel", "facts", F.lit("uninstrumented").alias("coverage"))


def promotion_facts(spark, sf_dir):
    _, facts = aggregate.promotion(channel_facts(spark, sf_dir), "channel", _directed())
    return facts.select("fact", "channel", "status")


def event_channels_two_bucket(spark, sf_dir):
    channels, _ = aggregate.promotion(channel_facts(spark, sf_dir), "channel", _directed())
    return ranking.two_buckets(channels, F.col("corroborated"), 400, F.desc("facts"), F.col("channel")).select("channel", "facts", "bucket")


def event_asymmetry(spark, sf_dir):
    tests = {"producers": F.col("predicate") == "PRODUCES", "consumers": F.col("predicate") == "CONSUMES"}
    return aggregate.sides(channel_facts(spark, sf_dir), "channel", tests)


def event_consumers(spark, sf_dir):
    """Consumers of channels that have producers, with the number of those."""
    facts = channel_facts(spark, sf_dir)
    made = facts.where("predicate = 'PRODUCES'").groupBy("channel").agg(F.count_distinct("service").alias("producers"))
    used = facts.where("predicate = 'CONSUMES'").select("channel", "service").distinct()
    return used.join(made, "channel")


def endpoints_by_shape(spark, sf_dir):
    paths = table(spark, sf_dir, "pages").select(C.path_shape(C.url_path("url")).alias("shape"), C.host("url").alias("host"))
    return paths.groupBy("shape").agg(F.count("*").alias("n"), F.count_distinct("host").alias("hosts")).orderBy(F.desc("n"), "shape").limit(100)


def endpoint_consumers(spark, sf_dir):
    rows = links(spark, sf_dir)
    provided, called = (rows.where(F.col("side") == s).select("host", "shape", "method").distinct() for s in ("EXPOSES", "CALLS"))
    met = joins.consumers(provided, called)
    return met.select(F.col("p.shape").alias("shape"), F.col("p.host").alias("provider"), F.col("c.host").alias("consumer")).distinct()


def domain_references(spark, sf_dir):
    """Facts on hosts named like ``th``, and in turn facts on the paths that those reach."""
    rows = links(spark, sf_dir).select("page", "host", "path")
    first = rows.where(F.contains("host", F.lit("thth")))
    second = rows.join(first.select("path").distinct(), "path", "left_semi").select("page", "host", "path")
    return first.union(second).distinct()


def unrouted_domains(spark, sf_dir):
    rows = links(spark, sf_dir)
    routed = rows.where("side = 'EXPOSES'").select("host").distinct()
    return rows.select("host").distinct().join(routed, "host", "left_anti")


def extract_links(spark, sf_dir):
    return links(spark, sf_dir).groupBy("page").agg(F.count("*").alias("links"), F.count_distinct("shape").alias("shapes"))


def extract_domains(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", C.host("url").alias("host"), C.is_domain(C.host("url")).alias("is_domain"))


def _contract(spark, sf_dir):
    rows = links(spark, sf_dir)
    return joins.reconciled(rows.where("side = 'EXPOSES'"), rows.where("side = 'CALLS'"), "shape")


def contract_matched(spark, sf_dir):
    return _contract(spark, sf_dir).where("side = 'matched'").select("shape", "left_rows", "right_rows")


def contract_left_only(spark, sf_dir):
    return _contract(spark, sf_dir).where("side = 'left_only'").select("shape", "left_rows")


def contract_right_only(spark, sf_dir):
    return _contract(spark, sf_dir).where("side = 'right_only'").select("shape", "right_rows")


def contract_possible_matches(spark, sf_dir):
    both = _contract(spark, sf_dir)
    left, right = (both.where(F.col("side") == s).select("shape") for s in ("left_only", "right_only"))
    return joins.possible_matches(left, right, "shape")


def _hosts(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.startswith("url", F.lit("https:")).alias("safe"), C.host("url").alias("host"), F.split(C.host("url"), r"\.").alias("parts"))


def runtime_suffix_link(spark, sf_dir):
    """Hosts linked to the service with their longest known suffix: three labels of hosts served by https, and all hosts' two."""
    hosts = _hosts(spark, sf_dir)
    lang = F.regexp_extract(F.col("host"), r"^([a-z])", 1)
    tail = lambda n: F.array_join(F.slice("parts", -n, n), ".")
    three = hosts.where(F.col("safe") & (F.size("parts") >= 3)).select(tail(3).alias("suffix"), F.concat(F.lit("svc-"), lang).alias("service"))
    two = hosts.where(F.size("parts") >= 2).select(tail(2).alias("suffix"), F.concat(F.lit("zone-"), lang).alias("service"))
    targets = hosts.select(F.col("host").alias("target"), "parts").distinct()
    return resolve.longest_suffix(targets, three.union(two).distinct(), "suffix")


def _met(spark, sf_dir):
    return joins.overlapping(spans(spark, sf_dir), ranges(spark, sf_dir), "key", 16)


def range_overlap_symbols(spark, sf_dir):
    return _met(spark, sf_dir).select("key", "name", "start", "stop", "from", "to", "enclosing")


def most_specific_spans(spark, sf_dir):
    return joins.most_specific(_met(spark, sf_dir), ["key", "from", "to"]).select("key", "name", "start", "stop", "from", "to")


def authz_status(spark, sf_dir):
    """Handlers (channels) with the policies (producers) and checks (consumers) that they have."""
    facts = channel_facts(spark, sf_dir)
    handlers = facts.select("channel").distinct()
    one = lambda p, n: facts.where(F.col("predicate") == p).groupBy("channel").agg(F.count("*").alias(n))
    rows = handlers.join(one("PRODUCES", "policies"), "channel", "left").join(one("CONSUMES", "checks"), "channel", "left")
    rows = rows.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("policies", "checks")})
    state = F.when(F.col("policies") > 0, F.when(F.col("checks") > 0, "enforced").otherwise("declared")).when(F.col("checks") > 0, "checked").otherwise("unprotected")
    return rows.withColumn("state", state)


def runtime_components(spark, sf_dir):
    facts = channel_facts(spark, sf_dir).select(F.col("service").cast("string").alias("component"), F.col("channel").alias("what"), "predicate")
    rows = links(spark, sf_dir).select(F.col("host").alias("component"), F.col("path").alias("what"), "side")
    streams = {
        "produces": facts.where("predicate = 'PRODUCES'"), "consumes": facts.where("predicate = 'CONSUMES'"),
        "exposes": rows.where("side = 'EXPOSES'"), "calls": rows.where("side = 'CALLS'"),
    }
    return aggregate.components(streams, "component", "what")


def search_services(spark, sf_dir):
    services = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.lower(F.concat_ws(" ", "c_name", "c_mktsegment")).alias("said"))
    return services.where(F.contains("said", F.lit("build"))).orderBy("c_name", "c_custkey").limit(40).select("c_custkey", "c_name")


QUERIES = {
    f.__name__: f
    for f in (
        promotion_demoted, promotion_facts, event_channels_two_bucket, event_asymmetry, event_consumers, endpoints_by_shape, endpoint_consumers,
        domain_references, unrouted_domains, extract_links, extract_domains, contract_matched, contract_left_only, contract_right_only,
        contract_possible_matches, runtime_suffix_link, range_overlap_symbols, most_specific_spans, authz_status, runtime_components, search_services,
    )
}

from .projections import PATH, SHAPE  # noqa: E402

_STATUS = f"""WITH {CHANNELS}, channels AS (
  SELECT channel, count(*) AS facts, bool_or(predicate IN ('PRODUCES', 'CONSUMES')) AS corroborated FROM channel_facts GROUP BY 1)"""
_CONTRACT = f"""WITH {LINKS}, a AS (SELECT shape, count(*) AS left_rows FROM links WHERE side = 'EXPOSES' GROUP BY 1),
b AS (SELECT shape, count(*) AS right_rows FROM links WHERE side = 'CALLS' GROUP BY 1)"""
_MET = f"""WITH {SPANS}, met AS (
  SELECT s.key, name, start, stop, "from", "to", start <= "from" AND "to" <= stop AS enclosing
  FROM spans s JOIN ranges r ON s.key = r.key AND start <= "to" AND "from" <= stop)"""
_HOSTS = f"SELECT starts_with(url, 'https:') AS safe, {HOST.format(x='url')} AS host, string_split({HOST.format(x='url')}, '.') AS parts FROM pages"

ORACLES = {
    "promotion_demoted": f"{_STATUS} SELECT channel, facts, 'uninstrumented' AS coverage FROM channels WHERE NOT corroborated",
    "promotion_facts": f"""{_STATUS} SELECT fact, channel, CASE WHEN corroborated THEN 'canonical' ELSE 'candidate' END AS status
FROM channel_facts JOIN channels USING (channel)""",
    "event_channels_two_bucket": f"""{_STATUS} SELECT channel, facts, CASE WHEN corroborated THEN 'known' ELSE 'candidate' END AS bucket
FROM channels ORDER BY corroborated DESC, facts DESC, channel LIMIT 400""",
    "event_asymmetry": f"""WITH {CHANNELS}, n AS (SELECT channel, count(*) FILTER (predicate = 'PRODUCES') AS producers, count(*) FILTER (predicate = 'CONSUMES') AS consumers
  FROM channel_facts GROUP BY 1) SELECT *, CASE WHEN producers > 0 AND consumers = 0 THEN 'only_producers' WHEN consumers > 0 AND producers = 0 THEN 'only_consumers' ELSE 'none' END AS asymmetry FROM n""",
    "event_consumers": f"""WITH {CHANNELS}, m AS (SELECT channel, count(DISTINCT service) AS producers FROM channel_facts WHERE predicate = 'PRODUCES' GROUP BY 1)
SELECT DISTINCT channel, service, producers FROM channel_facts JOIN m USING (channel) WHERE predicate = 'CONSUMES'""",
    "endpoints_by_shape": f"""WITH p AS (SELECT {SHAPE.format(x=PATH.format(x="url"))} AS shape, {HOST.format(x="url")} AS host FROM pages)
SELECT shape, count(*) AS n, count(DISTINCT host) AS hosts FROM p GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 100""",
    "endpoint_consumers": f"""WITH {LINKS} SELECT DISTINCT p.shape, p.host AS provider, c.host AS consumer FROM links p JOIN links c
ON p.shape = c.shape AND p.side = 'EXPOSES' AND c.side = 'CALLS' AND p.host <> c.host AND (p.method = c.method OR (p.method = 'ANY' AND c.method IS NOT NULL))""",
    "domain_references": f"""WITH {LINKS}, f AS (SELECT page, host, path FROM links WHERE contains(host, 'thth'))
SELECT * FROM f UNION SELECT page, host, path FROM links WHERE path IN (SELECT path FROM f)""",
    "unrouted_domains": f"WITH {LINKS} SELECT DISTINCT host FROM links WHERE host NOT IN (SELECT host FROM links WHERE side = 'EXPOSES')",
    "extract_links": f"WITH {LINKS} SELECT page, count(*) AS links, count(DISTINCT shape) AS shapes FROM links GROUP BY 1",
    "extract_domains": f"""SELECT page_id, {HOST.format(x="url")} AS host,
  regexp_matches({HOST.format(x="url")}, '^(\\*\\.)?([a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?\\.)+[a-z]{{2,63}}$') AS is_domain FROM pages""",
    "contract_matched": f"{_CONTRACT} SELECT shape, left_rows, right_rows FROM a JOIN b USING (shape)",
    "contract_left_only": f"{_CONTRACT} SELECT shape, left_rows FROM a ANTI JOIN b USING (shape)",
    "contract_right_only": f"{_CONTRACT} SELECT shape, right_rows FROM b ANTI JOIN a USING (shape)",
    "runtime_suffix_link": f"""WITH h AS ({_HOSTS}), s AS (
  SELECT array_to_string(parts[-3:], '.') AS suffix, 'svc-' || regexp_extract(host, '^([a-z])', 1) AS service FROM h WHERE safe AND len(parts) >= 3
  UNION SELECT array_to_string(parts[-2:], '.'), 'zone-' || regexp_extract(host, '^([a-z])', 1) FROM h WHERE len(parts) >= 2
), t AS (SELECT DISTINCT host AS target, parts FROM h WHERE len(parts) >= 2),
e AS (SELECT target, parts, unnest(range(2, len(parts) + 1)) AS n_parts FROM t),
hit AS (SELECT target, n_parts, service FROM e JOIN s ON suffix = array_to_string(parts[-n_parts:], '.')),
top AS (SELECT * FROM hit QUALIFY n_parts = max(n_parts) OVER (PARTITION BY target))
SELECT target, n_parts, count(DISTINCT service) AS services, CASE WHEN count(DISTINCT service) = 1 THEN min(service) END AS service FROM top GROUP BY 1, 2""",
    "range_overlap_symbols": f"{_MET} SELECT * FROM met",
    "most_specific_spans": f"""{_MET} SELECT key, name, start, stop, "from", "to" FROM met a WHERE NOT EXISTS (
  SELECT 1 FROM met b WHERE b.key = a.key AND b."from" = a."from" AND a.start <= b.start AND b.stop <= a.stop AND a.stop - a.start > b.stop - b.start)""",
    "authz_status": f"""WITH {CHANNELS}, n AS (SELECT channel, count(*) FILTER (predicate = 'PRODUCES') AS policies, count(*) FILTER (predicate = 'CONSUMES') AS checks FROM channel_facts GROUP BY 1)
SELECT *, CASE WHEN policies > 0 AND checks > 0 THEN 'enforced' WHEN policies > 0 THEN 'declared' WHEN checks > 0 THEN 'checked' ELSE 'unprotected' END AS state FROM n""",
    "runtime_components": f"""WITH {CHANNELS}, {LINKS}, t AS (
  SELECT service::VARCHAR AS component, channel AS what, lower(predicate) AS tag FROM channel_facts WHERE predicate IN ('PRODUCES', 'CONSUMES')
  UNION ALL SELECT host, path, lower(side) FROM links)
SELECT component, array_to_string(list_sort(list_distinct(list(tag))), ',') AS categories, count(*) FILTER (tag = 'produces') AS produces_rows,
  count(*) FILTER (tag = 'consumes') AS consumes_rows, count(*) FILTER (tag = 'exposes') AS exposes_rows, count(*) FILTER (tag = 'calls') AS calls_rows,
  count(DISTINCT what) AS values FROM t GROUP BY 1""",
    "search_services": "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name || ' ' || c_mktsegment), 'build') ORDER BY c_name, c_custkey LIMIT 40",
}
