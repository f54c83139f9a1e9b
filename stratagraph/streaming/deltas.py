"""Snapshot deltas as a stream: an extension, as snapshots are otherwise built in batches.

New files of rows are merged into a table as they come.  Merging keeps the
first row of each key, so a batch that is replayed after a failure changes
nothing; a batch whose rows are all known is skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stratagraph.operators.aggregate import first_wins


PARTS = 256


def read_deltas(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files of JSON lines that are put into ``path``; a malformed line fails."""
    return spark.readStream.schema(schema).option("mode", "FAILFAST").json(path)


def merge_into(path: str, key: str, order: str):
    """A batch function that adds to the table in ``path`` the rows whose key it lacks, the first of each.

    The table is kept in ``PARTS`` parts by a hash of the key; a batch reads the keys of the parts that it touches alone.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = first_wins(batch.where(F.col(key).isNotNull()), [key], F.col(order))
        rows = rows.withColumn("part", F.pmod(F.xxhash64(key), F.lit(PARTS)).cast("int"))
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            parts = [r["part"] for r in rows.select("part").distinct().collect()]  # PARTS numbers at most
            rows = rows.join(spark.read.parquet(path).where(F.col("part").isin(parts)).select("part", key), ["part", key], "left_anti")
        if not rows.isEmpty():
            rows.select(*batch.columns, "part").repartition("part").write.mode("append").partitionBy("part").parquet(path)

    return merge


def start(deltas: DataFrame, path: str, key: str, order: str, checkpoint: str) -> StreamingQuery:
    """Merge all that is there, then stop; run again to go on from the checkpoint."""
    writer = deltas.writeStream.foreachBatch(merge_into(path, key, order)).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def stale_repos(snapshot: DataFrame, heads: DataFrame) -> DataFrame:
    """(repo, commit_sha, head): repositories whose snapshot isn't of their head commit, or that have none."""
    old = snapshot.select("repo", "commit_sha")
    new = heads.select("repo", F.col("commit_sha").alias("head"))
    return new.join(old, "repo", "left").where(~F.col("commit_sha").eqNullSafe(F.col("head")))
