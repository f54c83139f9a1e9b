"""Snapshots of a graph: read, validated, merged and written with Spark's own readers and writers.

A snapshot is a folder with the tables entities, facts, evidence, coverage and
perhaps support_facts, each a folder of Parquet or of JSON lines, and a manifest.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stratagraph.functions import columns as C
from stratagraph.operators.aggregate import first_wins

SCHEMAS = {
    "entities": "ordinal long, entity_id string, urn string, kind string, identity map<string,string>, properties map<string,string>, canonical_status string",
    "facts": "ordinal long, fact_id string, predicate string, subject_id string, object_id string, qualifier map<string,string>, canonical_status string",
    "support_facts": "ordinal long, fact_id string, predicate string, subject_id string, object_id string, qualifier map<string,string>, canonical_status string",
    "evidence": "ordinal long, evidence_id string, target_type string, target_id string, derivation_class string, source_system string, "
    "source_ref map<string,string>, bytes_ref struct<repo:string,commit_sha:string,path:string,line_start:int,line_end:int>, confidence double, ingested_at string",
    "coverage": "ordinal long, coverage_id string, tenant_id string, predicate string, scope_ref map<string,string>, state string, source_system string, checked_at string",
}
KEYS = {"entities": "entity_id", "facts": "fact_id", "support_facts": "fact_id", "evidence": "evidence_id", "coverage": "coverage_id"}
OPTIONAL = ("support_facts",)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_table(spark: SparkSession, root: str, name: str, form: str = "parquet") -> DataFrame:
    """One table; a missing optional table is empty, a malformed JSON line fails."""
    path, schema = f"{root}/{name}", SCHEMAS[name]
    if name in OPTIONAL and not _exists(spark, path):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    if form == "json":
        reader = reader.option("mode", "FAILFAST")
    rows = reader.format(form).load(path)
    return rows.withColumn("canonical_status", C.status("canonical_status")) if "canonical_status" in rows.columns else rows


def read_snapshot(spark: SparkSession, root: str, form: str = "parquet") -> dict[str, DataFrame]:
    return {name: read_table(spark, root, name, form) for name in SCHEMAS}


def valid_coordinate(ref: str = "bytes_ref") -> Column:
    """A coordinate with repo, commit and path, a first line over 0 and no last line before it."""
    named = [F.coalesce(F.col(f"{ref}.{x}"), F.lit("")) != "" for x in ("repo", "commit_sha", "path")]
    lines = (F.col(f"{ref}.line_start") > 0) & (F.col(f"{ref}.line_end") >= F.col(f"{ref}.line_start"))
    return F.coalesce(reduce(Column.__and__, [*named, lines]), F.lit(False))


def with_ids(rows: DataFrame, prefix: str, into: str, *parts: str) -> DataFrame:
    """``rows`` with the stable id of their identifying columns."""
    return rows.withColumn(into, C.stable_hash(prefix, *parts))


def merged(tables: list[DataFrame], key: str) -> DataFrame:
    """The tables' rows, the first of each key; tables count in their order, rows by ordinal."""
    tagged = [t.withColumn("source_order", F.lit(i)) for i, t in enumerate(tables)]
    rows = reduce(DataFrame.unionByName, tagged)
    return first_wins(rows, [key], F.struct("source_order", "ordinal")).drop("source_order")


def conflicts(rows: DataFrame, key: str, ignore: tuple[str, ...] = ("ordinal", "checked_at", "ingested_at")) -> DataFrame:
    """(key, versions): keys whose rows differ in anything but ``ignore``."""
    body = [c for c in rows.columns if c not in (key, *ignore)]
    seen = rows.select(key, F.sha2(F.to_json(F.struct(*[F.col(c) for c in body])), 256).alias("body"))
    return seen.groupBy(key).agg(F.count_distinct("body").alias("versions")).where("versions > 1")


def write_snapshot(tables: dict[str, DataFrame], root: str) -> None:
    """Write each table, the first row of each key, facts by predicate; an empty support table isn't written."""
    for name, rows in tables.items():
        out = first_wins(rows, [KEYS[name]], F.col("ordinal")).select(*rows.columns)
        if name in OPTIONAL and out.isEmpty():
            continue
        out.write.mode("overwrite").parquet(f"{root}/{name}")


def fingerprint(repos: DataFrame) -> str:
    """A hash over the sorted (repo, commit) pairs: equal for equal builds, whatever their order.  A fleet's pairs fit the driver."""
    pairs = repos.agg(F.sha2(F.to_json(F.array_sort(F.collect_set(F.struct("repo", "commit_sha")))), 256)).first()
    return pairs[0]
