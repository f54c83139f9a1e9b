"""Contiguous shards of near equal bytes, by global prefix sums.

Rows are put in one global order by a range exchange.  Each partition's total
is taken, the totals are summed up in partition order (one row a partition),
and a running sum inside each partition gives every row its global byte offset.
A row belongs to the shard that its middle byte falls in, so cuts stand at
equal targets and every shard is a contiguous piece of the order.

Cost: one range exchange of the rows, one written copy of them, and a sort of
(order, size) pairs.  What is broadcast has one entry a partition and a shard.
Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .columns import free
from .scratch import written

ROW_BITS = 33  # monotonically_increasing_id keeps the row's place in these


def contiguous_shards(
    df: DataFrame,
    n_shards: int,
    order_by: list[Column],
    size: Column,
    shard: str = "shard",
    slot: str = "slot",
) -> DataFrame:
    """``df`` with ``shard`` (0 to ``n_shards`` - 1) and ``slot`` (gapless from 0).

    Nulls in the order come first; rows with equal keys are told apart by their
    place in the input, which only a written copy fixes.  Null sizes count 0; if
    all sizes are 0, rows count 1 each.  Columns of the input that are named as
    the results are replaced.  An empty table gives an empty result.  No shard
    is larger than the target by more than one row's size.
    """
    if n_shards < 1:
        raise ValueError("n_shards must be at least 1")
    spark = df.sparkSession
    df = df.drop(*[c for c in df.columns if c.lower() in (shard.lower(), slot.lower())])
    bytes_, tie, seq, part, cuts = free(df, "__bytes", "__tie", "__seq", "__part", "__cuts")
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = df.withColumn(bytes_, F.coalesce(size.cast("long"), F.lit(0))).withColumn(
        tie, F.monotonically_increasing_id()
    )
    ranged = (
        keyed.repartitionByRange(n_parts, *order_by, F.col(tie))
        .sortWithinPartitions(*order_by, F.col(tie))
        .drop(tie)
        .withColumn(seq, F.monotonically_increasing_id())
    )
    rows = written(ranged, "shards").withColumn(part, F.shiftright(seq, ROW_BITS))

    slim = rows.select(F.col(seq).alias("seq"), F.col(part).alias("part"), F.col(bytes_).alias("size"))
    by_part = Window.orderBy("part")
    before = by_part.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    parts = (
        slim.groupBy("part")
        .agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
        .select(
            "part",
            F.coalesce(F.sum("size").over(before), F.lit(0)).alias("bytes_before"),
            F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
            F.sum("size").over(everything).alias("bytes_all"),
            F.sum("rows").over(everything).alias("rows_all"),
        )
    )
    inside = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    at = (
        slim.withColumn("prefix", F.coalesce(F.sum("size").over(inside), F.lit(0)))
        .join(F.broadcast(parts), "part")
        .withColumn("row", F.col("rows_before") + F.col("seq").bitwiseAND((1 << ROW_BITS) - 1))
        .withColumn(
            "shard",
            F.when(
                F.col("bytes_all") > 0,
                F.expr(f"((bytes_before + prefix) * 2 + size) * {n_shards} div (bytes_all * 2)"),
            ).otherwise(F.expr(f"row * {n_shards} div rows_all")),
        )
        .withColumn("shard", F.least("shard", F.lit(n_shards - 1)).cast("int"))
    )
    pieces = at.groupBy("part", "shard").agg(
        F.min("seq").alias("start"), F.min("row").alias("row"), F.first("rows_before").alias("rows_before")
    )
    pieces = pieces.withColumn("first_row", F.min("row").over(Window.partitionBy("shard")))
    by_piece = pieces.groupBy(F.col("part").alias(part)).agg(
        F.collect_list(F.struct("start", "shard", (F.col("rows_before") - F.col("first_row")).alias("shift"))).alias(cuts)
    )
    mine = F.array_max(F.filter(cuts, lambda c: c["start"] <= F.col(seq)))
    return (
        rows.join(F.broadcast(by_piece), part)
        .withColumn(cuts, mine)
        .withColumn(shard, F.col(cuts)["shard"])
        .withColumn(slot, F.col(cuts)["shift"] + F.col(seq).bitwiseAND((1 << ROW_BITS) - 1))
        .drop(bytes_, seq, part, cuts)
    )


N_SHARDS = 40


def op7_byte_prefix_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, in the order of doc_id, in 40 shards of near equal bytes; rows of equal texts aren't kept together."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return contiguous_shards(slim, N_SHARDS, [F.col("doc_id")], F.col("size")).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUERIES = {"op7_byte_prefix_shards": op7_byte_prefix_shards}

ORACLES = {
    "op7_byte_prefix_shards": f"""
WITH poly(i, n, v) AS (
  SELECT range, 0, range::UBIGINT FROM range(256)
), step AS (
  SELECT i, list_reduce(list_prepend(v, range(8)::UBIGINT[]),
      lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS c
  FROM poly
), tab AS (SELECT list(c ORDER BY i) AS t FROM step),
d AS (
  SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, ''))::BIGINT + 16 AS size FROM documents
), p AS (
  SELECT *, (sum(size) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS before,
    (sum(size) OVER ())::BIGINT AS whole
  FROM d
), s AS (
  SELECT *, least({N_SHARDS - 1}, ((before * 2 + size) * {N_SHARDS}) // (whole * 2))::INTEGER AS shard FROM p
)
SELECT doc_id, size,
  xor(list_reduce(list_prepend(4294967295::UBIGINT,
      list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: ('0x' || x)::UBIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) % 256)::BIGINT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32,
  'bytes' AS law, shard,
  (row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1)::BIGINT AS slot,
  NULL::INTEGER AS grown_shard
FROM s, tab
"""
}
