"""Secret scans, with corpus-wide ownership of what they find.

Spans are found by regular expressions: the gaps between matches come from
``split`` and the matches from ``regexp_extract_all``, so running sums give
code-point offsets without leaving the JVM.  Each candidate value is hashed and
counted over the whole corpus by distinct repositories and owners.  A value
that one owner alone holds and that doesn't look like a placeholder is marked
with an ``owned`` span; a value that several owners hold is a copied example.

Cost: one scan with regular expressions, whose findings are written once;
everything after works on findings, not texts.  Counting pre-aggregates to one
row a (value, repository) before its exchange, so a hot value stays small.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .scratch import written

# The patterns of the base kinds and of other opaque tokens.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
OPAQUE = r"[A-Za-z0-9+/_-]{20,}={0,2}"
PLACEHOLDER = r"(?i)example|sample|dummy|placeholder|changeme|your_|xxxx|0000000|1234567"
KINDS = ("assign", "access", "hex", "opaque", "owned")
MIN_ASSIGN = 12  # characters of the value
SALTS = 8
MAX_OWNERS = 1  # a value with more is a copied example


def _found(text: Column, pattern: str) -> Column:
    """The matches in order, each with the length of the gap before it."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.transform(F.split(text, pattern, -1), lambda x: F.char_length(x).cast("long"))
    both = F.zip_with(F.slice(gaps, F.lit(1), F.size(matches)), matches, lambda g, m: F.struct(g.alias("gap"), m.alias("match")))
    none = F.array().cast("array<struct<gap:bigint,match:string>>")
    return F.when(text.rlike(pattern), both).otherwise(none)


def secrets(df: DataFrame, text: Column, repository: Column, owner: Column, keep: dict[str, Column]) -> DataFrame:
    """A row for each row of ``df``: the ``keep`` columns, counts, and spans.

    Result: the columns of ``keep``; n_assign, n_access, n_hex, n_owned,
    n_copied, most_repositories (long: of the row's most widely held value, in how many repositories it is); base and all: arrays of structs (start, kind, end), kind
    being an index of KINDS, in order of start and kind.  Offsets are code
    points, ends exclusive.  A null text counts as an empty one and has no
    spans; a null repository or owner counts as one unnamed repository or owner.
    Repeated rows are separate rows of one repository.  Columns of ``df`` beside
    the given expressions are not read, so their names can't clash.
    """
    clean = F.coalesce(text, F.lit(""))
    hits = written(
        df.select(
            *[c.alias(f"keep_{name}") for name, c in keep.items()],
            F.coalesce(repository.cast("string"), F.lit("")).alias("repository"),
            F.coalesce(owner.cast("string"), F.lit("")).alias("owner"),
            *[_found(clean, p).alias(f"found{i}") for i, p in enumerate((ASSIGN, ACCESS, HEX, OPAQUE))],
            F.monotonically_increasing_id().alias("rid"),
        ),
        "secrets",
    )

    def numbered(i: int) -> Column:
        return F.transform(
            f"found{i}", lambda x, n: F.struct(F.lit(i).alias("kind"), n.alias("n"), x["gap"].alias("gap"), x["match"].alias("match"))
        )

    each = hits.select("rid", "repository", "owner", F.explode(F.concat(*[numbered(i) for i in range(4)])).alias("x")).select(
        "rid", "repository", "owner", "x.*"
    )
    upto = Window.partitionBy("rid", "kind").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(F.col("kind") == 0, F.regexp_extract("match", ASSIGN, 2)).otherwise(F.col("match"))
    placed = (
        each.withColumn("long", F.char_length("match").cast("long"))
        .withColumn("end", F.sum(F.col("gap") + F.col("long")).over(upto))
        .withColumn("start", F.col("end") - F.col("long"))
        .withColumn("value", value)
    )
    mixed = F.col("value").rlike("[0-9]") & F.col("value").rlike("[A-Z]") & F.col("value").rlike("[a-z]")
    passing = F.when(F.col("kind") == 0, F.char_length("value") >= MIN_ASSIGN).when(F.col("kind") == 3, mixed).otherwise(True)
    spans = placed.where(passing).select(
        "rid", "kind", "start", "end", "repository", "owner",
        (F.col("end") - F.char_length("value")).alias("value_start"),
        F.unhex(F.sha2("value", 256)).alias("hash"),
        F.col("value").rlike(PLACEHOLDER).alias("placeholder"),
    )
    spans = written(spans, "spans")
    # distinct repositories of an owner, then owners: each value is one row an owner before the last exchange
    holders = (
        spans.groupBy("hash", "owner", "repository")
        .agg(F.max("placeholder").alias("dummy"))
        .groupBy("hash", "owner")
        .agg(F.count("*").alias("repositories"), F.max("dummy").alias("dummy"))
        .groupBy("hash")
        .agg(F.count("*").alias("owners"), F.sum("repositories").alias("repositories"), F.max("dummy").alias("dummy"))
    )
    # a value that many rows hold is dealt by salt: its one row of ``holders`` is repeated
    salted = holders.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = spans.withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int"))
    judged = dealt.join(salted.hint("merge"), ["hash", "salt"]).select(
        "rid",
        F.struct(F.col("value_start").alias("start"), F.lit(4).alias("kind"), "end").alias("span"),
        ((F.col("owners") <= MAX_OWNERS) & ~F.col("dummy")).alias("owned"),
        "repositories",
    )
    base = spans.where("kind < 3").select("rid", F.struct("start", "kind", "end").alias("span"), *_nulls("owned boolean", "repositories long"))
    kept = hits.select("rid", F.struct(*[F.col(f"keep_{n}").alias(n) for n in keep]).alias("keep"))
    found = base.union(judged).withColumn("keep", F.lit(None).cast(kept.schema["keep"].dataType))
    whole = kept.select("rid", F.lit(None).cast(found.schema["span"].dataType).alias("span"), *_nulls("owned boolean", "repositories long"), "keep").union(found)
    by_row = whole.groupBy("rid").agg(
        F.first("keep", ignorenulls=True).alias("keep"),
        F.array_sort(F.collect_set(F.when(F.col("owned").isNull(), F.col("span")))).alias("base"),
        F.array_sort(F.collect_set(F.when(F.coalesce("owned", F.lit(True)), F.col("span")))).alias("all"),
        F.size(F.collect_set(F.when(F.col("owned"), F.col("span")))).cast("long").alias("n_owned"),
        F.size(F.collect_set(F.when(~F.col("owned"), F.col("span")))).cast("long").alias("n_copied"),
        F.coalesce(F.max("repositories"), F.lit(0)).alias("most_repositories"),
    )
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long")
    return by_row.select("keep.*", *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)], "n_owned", "n_copied", "most_repositories", "base", "all")


def _nulls(*columns: str) -> list[Column]:
    return [F.lit(None).cast(kind).alias(name) for name, kind in (c.split() for c in columns)]


def as_text(spans: Column) -> Column:
    """kind:start:end for each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ","
    )


def op4_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans in each document; a document's source is its repository, and what stands before a slash in it the owner."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = secrets(docs, F.col("text"), F.col("source"), F.substring_index("source", "/", 1), {"doc_id": F.col("doc_id")})
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex",
        F.sha2(as_text(F.col("base")), 256).alias("base_sha256"), as_text(F.col("all")).alias("spans"), "n_owned", "n_copied", "most_repositories",
    )


QUERIES = {"op4_secret_ownership": op4_secret_ownership}


def _sql(kind: int, pattern: str, value: str, passing: str) -> str:
    p = pattern.replace("'", "''")
    return f"""
  SELECT row, owner, repository, {kind} AS kind, pos - length(m) AS start, pos AS stop, {value.format(p=p)} AS value FROM (
    SELECT row, owner, repository, m, sum(g + length(m)) OVER (PARTITION BY row ORDER BY n)::BIGINT AS pos FROM (
      SELECT row, owner, repository, unnest(ms) AS m, unnest(list_transform(gaps[1:len(ms)], lambda x: length(x))) AS g, unnest(range(1, len(ms) + 1)) AS n
      FROM (SELECT row, owner, repository, regexp_extract_all(text, '{p}') AS ms, regexp_split_to_array(text, '{p}') AS gaps FROM d)))
  WHERE {passing.format(p=p)}"""


ORACLES = {
    "op4_secret_ownership": rf"""
WITH d AS (
  SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, coalesce(source, '') AS repository, split_part(coalesce(source, ''), '/', 1) AS owner FROM documents
), spans AS (
  {_sql(0, ASSIGN, "regexp_extract(m, '{p}', 2)", f"length(regexp_extract(m, '{{p}}', 2)) >= {MIN_ASSIGN}")}
  UNION ALL {_sql(1, ACCESS, "m", "true")}
  UNION ALL {_sql(2, HEX, "m", "true")}
  UNION ALL {_sql(3, OPAQUE, "m", "regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[a-z]')")}
), holders AS (
  SELECT value, count(DISTINCT owner) <= {MAX_OWNERS} AND NOT bool_or(regexp_matches(value, '{PLACEHOLDER}')) AS owned, count(DISTINCT repository) AS repositories FROM spans GROUP BY value
), listed AS (
  SELECT DISTINCT row, kind, start, stop, NULL::BOOLEAN AS owned, NULL::BIGINT AS repositories FROM spans WHERE kind < 3
  UNION ALL SELECT DISTINCT row, 4, stop - length(value), stop, owned, repositories FROM spans JOIN holders USING (value)
), named AS (
  SELECT *, ['assign', 'access', 'hex', 'opaque', 'owned'][kind + 1] || ':' || start || ':' || stop AS said FROM listed
)
SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
  sha256(coalesce(string_agg(said, ',' ORDER BY start, kind, stop) FILTER (owned IS NULL), '')) AS base_sha256,
  coalesce(string_agg(said, ',' ORDER BY start, kind, stop) FILTER (coalesce(owned, true)), '') AS spans,
  count(*) FILTER (owned) AS n_owned, count(*) FILTER (NOT owned) AS n_copied, coalesce(max(repositories), 0) AS most_repositories
FROM d LEFT JOIN named USING (row) GROUP BY row, doc_id
"""
}
