"""The supplied tables read as graph tables, and the same projections in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.functions import columns as C


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CALLS (src, dst, ordinal): the part of a line to that of the next line of its order; ordinal is the first place."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    after = lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("l_linenumber"), F.col("l_partkey").alias("dst"))
    pairs = lines.withColumnRenamed("l_partkey", "src").join(after, ["l_orderkey", "l_linenumber"])
    return pairs.groupBy("src", "dst").agg(F.min(F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ordinal"))


CALLS = """calls AS (
  SELECT a.l_partkey AS src, b.l_partkey AS dst, min(a.l_orderkey * 100 + a.l_linenumber) AS ordinal
  FROM lineitem a JOIN lineitem b ON b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 GROUP BY 1, 2)"""


def imports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IMPORTS (module, package, category, ordinal): orders that use brand/type packages."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("/", "p_brand", "p_type").alias("package"))
    category = F.when(F.col("l_returnflag") == "A", "third_party").when(F.col("l_returnflag") == "N", "internal_module").otherwise("unknown")
    rows = lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).withColumn("category", category)
    return rows.groupBy(F.col("l_orderkey").alias("module"), "package", "category").agg(F.min("l_linenumber").cast("long").alias("ordinal"))


IMPORTS = """imports AS (
  SELECT l_orderkey AS module, p_brand || '/' || p_type AS package,
    CASE l_returnflag WHEN 'A' THEN 'third_party' WHEN 'N' THEN 'internal_module' ELSE 'unknown' END AS category,
    min(l_linenumber)::BIGINT AS ordinal
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"""


def provider_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(consumer, provider): orders and the nations of their lines' suppliers."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = lines.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("l_orderkey").alias("consumer"), F.col("n_name").alias("provider")).distinct()


PROVIDERS = """providers AS (
  SELECT DISTINCT l_orderkey AS consumer, n_name AS provider
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def channel_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event facts (fact, service, channel, predicate): channel is the key of props and the day of the month."""
    events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    kind = F.col("event_type")
    predicate = F.when(kind.isin("signup", "purchase"), "PRODUCES").when(kind.isin("click", "view"), "CONSUMES").otherwise("REFERENCES")
    channel = F.concat_ws(":", F.get_json_object("props", "$.k"), F.dayofmonth("ts").cast("string"))
    return events.select(F.col("event_id").alias("fact"), F.col("user_id").alias("service"), channel.alias("channel"), predicate.alias("predicate"), "ts")


CHANNELS = """channel_facts AS (
  SELECT event_id AS fact, user_id AS service, json_extract_string(props, '$.k') || ':' || day(ts) AS channel,
    CASE WHEN event_type IN ('signup', 'purchase') THEN 'PRODUCES' WHEN event_type IN ('click', 'view') THEN 'CONSUMES' ELSE 'REFERENCES' END AS predicate, ts
  FROM events)"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Endpoint facts of pages (page, host, path, shape, side, method): links of even pages are exposed, of odd ones called."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    hrefs = F.explode(F.regexp_extract_all("html", F.lit('href="(/[^"]*)"'), F.lit(1)))
    rows = pages.select(F.col("page_id").alias("page"), C.host("url").alias("host"), hrefs.alias("path")).distinct()
    side = F.when(F.col("page") % 2 == 0, "EXPOSES").otherwise("CALLS")
    method = F.when(F.col("page") % 5 == 0, "ANY").when(F.col("page") % 5 == 1, F.lit(None)).when(F.col("page") % 3 == 0, "POST").otherwise("GET")
    return rows.withColumns({"shape": C.path_shape("path"), "side": side, "method": method})


SHAPE = "array_to_string(list_transform(string_split(regexp_replace({x}, '(.)/+$', '\\1'), '/'), lambda s: CASE WHEN regexp_matches(s, '^(:[^/]+|<[^/>]*>|\\{{[^/}}]*\\}}|[0-9]+)$') THEN '{{}}' ELSE s END), '/')"
HOST = "lower(regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)', 1))"
PATH = "CASE WHEN regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract({x}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) END"

LINKS = f"""links AS (
  SELECT *, {SHAPE.format(x="path")} AS shape, CASE WHEN page % 2 = 0 THEN 'EXPOSES' ELSE 'CALLS' END AS side,
    CASE WHEN page % 5 = 0 THEN 'ANY' WHEN page % 5 = 1 THEN NULL WHEN page % 3 = 0 THEN 'POST' ELSE 'GET' END AS method
  FROM (SELECT DISTINCT page_id AS page, {HOST.format(x="url")} AS host, unnest(regexp_extract_all(html, 'href="(/[^"]*)"', 1)) AS path FROM pages))"""


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row a line (ordinal, fact, derivation_class, source_system, ingested_at) for the fact that its part has its brand."""
    lines = table(spark, sf_dir, "lineitem")
    both = F.concat("l_linestatus", "l_returnflag")
    kind = F.lit("static_inferred")
    for k, v in CLASSES.items():
        kind = F.when(both == k, v).otherwise(kind)
    return lines.select(
        (F.col("l_orderkey") * 100 + F.col("l_linenumber")).alias("ordinal"), F.col("l_partkey").alias("fact"), kind.alias("derivation_class"),
        F.concat(F.lit("sys"), (F.col("l_suppkey") % 7).cast("string")).alias("source_system"), F.col("l_shipdate").alias("ingested_at"),
        F.col("l_quantity").alias("quantity"),
    )


CLASSES = {
    "OA": "authoritative_declared", "OR": "authoritative_static", "ON": "runtime_observed",
    "FA": "deterministic_static", "FR": "manual_override",
}
EVIDENCE = f"""evidence AS (
  SELECT l_orderkey * 100 + l_linenumber AS ordinal, l_partkey AS fact,
    CASE l_linestatus || l_returnflag {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CLASSES.items())} ELSE 'static_inferred' END AS derivation_class,
    'sys' || (l_suppkey % 7) AS source_system, l_shipdate AS ingested_at, l_quantity AS quantity
  FROM lineitem)"""


def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage (doc, state) of labelled documents."""
    state = (
        F.when((F.col("quality") == 1) & (F.col("toxic") == 0), "instrumented")
        .when(F.col("quality") == 1, "partially_instrumented")
        .when(F.col("toxic") == 0, "uninstrumented")
        .otherwise("stale")
    )
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("doc"), state.alias("state"))


COVERAGE = """coverage AS (
  SELECT doc_id AS doc, CASE WHEN quality = 1 AND toxic = 0 THEN 'instrumented' WHEN quality = 1 THEN 'partially_instrumented'
    WHEN toxic = 0 THEN 'uninstrumented' ELSE 'stale' END AS state FROM labels)"""


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbol spans (key, name, start, stop): first to last day, of all time, that a user has events of k div 10."""
    day = F.datediff("ts", F.lit("1995-01-01"))
    events = table(spark, sf_dir, "events").select("user_id", (F.get_json_object("props", "$.k").cast("int") / 10).cast("int").alias("name"), day.alias("day"))
    return events.groupBy(F.col("user_id").alias("key"), "name").agg(F.min("day").alias("start"), F.max("day").alias("stop"))


def ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed ranges (key, from, to): each user's three-day windows that begin on a day of an error."""
    day = F.datediff("ts", F.lit("1995-01-01"))
    errors = table(spark, sf_dir, "events").where("event_type = 'error'").select(F.col("user_id").alias("key"), day.alias("from")).distinct()
    return errors.withColumn("to", F.col("from") + 2)


SPANS = """spans AS (
  SELECT user_id AS key, json_extract_string(props, '$.k')::INT // 10 AS name,
    min(date_diff('day', DATE '1995-01-01', ts::DATE))::INT AS start, max(date_diff('day', DATE '1995-01-01', ts::DATE))::INT AS stop FROM events GROUP BY 1, 2),
ranges AS (
  SELECT DISTINCT user_id AS key, date_diff('day', DATE '1995-01-01', ts::DATE)::INT AS "from", date_diff('day', DATE '1995-01-01', ts::DATE)::INT + 2 AS "to"
  FROM events WHERE event_type = 'error')"""
