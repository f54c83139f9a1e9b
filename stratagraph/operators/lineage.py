"""Cutting the lineage of loops, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept by a reliable checkpoint in ``spark.checkpoint.dir``; a local session may have a folder of its own."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        there = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not there and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
        context.setCheckpointDir(there or tempfile.mkdtemp(prefix="stratagraph-"))
    return df.checkpoint()
