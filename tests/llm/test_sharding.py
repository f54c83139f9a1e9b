from pyspark.sql import functions as F

from stratagraph.llm.sharding import contiguous_shards


def shards(df, n, size="size"):
    return contiguous_shards(df, n, [F.col("id")], F.col(size)).collect()


def test_cuts_at_equal_targets(spark):
    rows = [(i, (i * 37) % 101) for i in range(500)]
    got = sorted(shards(spark.createDataFrame(rows, "id long, size long").repartition(5), 7), key=lambda r: r.id)
    whole, before = sum(s for _, s in rows), 0
    slots = {}
    for r in got:
        shard = min(6, (2 * before + r.size) * 7 // (2 * whole))
        assert (r.shard, r.slot) == (shard, slots.get(shard, 0))
        slots[shard] = slots.get(shard, 0) + 1
        before += r.size
    totals = [sum(r.size for r in got if r.shard == s) for s in range(7)]
    assert max(totals) - whole / 7 <= 101 and whole / 7 - min(totals) <= 101


def test_ties_nulls_clashes_and_empty(spark):
    rows = [(None, 5, "a"), (None, None, "b"), (1, 5, "c"), (1, 5, "c"), (1, 5, "c"), (2, 0, None)]
    df = spark.createDataFrame(rows, "id long, size long, SHARD string")
    got = contiguous_shards(df, 3, [F.col("id")], F.col("size"))
    assert got.columns == ["id", "size", "shard", "slot"]
    out = got.collect()
    assert len(out) == 6 and sorted(r.slot for r in out if r.shard == 0)[0] == 0
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert shards(df.where("false"), 3) == []
    nothing = shards(df.withColumn("none", F.lit(0)), 2, "none")
    assert sorted(r.shard for r in nothing) == [0, 0, 0, 1, 1, 1]
