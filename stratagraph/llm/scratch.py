"""Written tables that cut lineage, in the folder that the whole cluster shares.

The folder is the session's ``spark.checkpoint.dir``.  Only a session that has
none (a test, a laptop) gets one of its own under the local temporary folder.
Tables are Parquet written by Spark, so they survive lost executors.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, str] = {}  # path -> the scope that it was made in
_scopes = [""]


@contextmanager
def scope(name: str) -> Iterator[None]:
    """Tables made inside belong to ``name``, unless a scope that is open already has them."""
    _scopes.append(_scopes[-1] or name)
    try:
        yield
    finally:
        _scopes.pop()


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; set to a fresh local one where a local session has none."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the whole cluster shares")
    if not there:
        there = "file://" + tempfile.mkdtemp(prefix="stratagraph-")
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = _scopes[-1]
    return path


BATCH_ROWS = 1000  # of texts that a Python worker holds at once
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """The session's batches of rows for Python are BATCH_ROWS at most while this is open."""
    old = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(BATCH_ROWS if int(old) <= 0 else min(int(old), BATCH_ROWS)))
    try:
        yield
    finally:
        spark.conf.set(_BATCH, old)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once and read back: later uses don't compute it again."""
    spark = df.sparkSession
    path = new_path(spark, name)
    with _small_batches(spark):
        df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def release(spark: SparkSession, keep: DataFrame) -> None:
    """Delete the open scope's tables, but for those that ``keep`` reads."""
    read = keep.inputFiles()
    for path in [p for p, owner in _made.items() if owner == _scopes[-1]]:
        if not any(f"/{path.rsplit('/', 1)[1]}/" in f for f in read):
            _delete(spark, path)
            del _made[path]


@atexit.register
def _clean() -> None:
    """Delete what is left when the driver's Python ends while its session still runs."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        for path in list(_made):
            _delete(spark, path)
            del _made[path]
